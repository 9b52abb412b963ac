"""Language ID and quality classifier: held-out accuracy, brute force, odd input."""

import itertools

import numpy as np
import pytest

from contest_panel.llm import language, quality, queries


def test_language_held_out(spark, docs):
    found = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = found[found.held_out].merge(known, on="doc_id")
    assert len(found) == len(known) and (both.lang == both.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    text = np.repeat([0, 2, 3], [5, 1, 4])
    scores = rng.normal(size=(len(text), 3)).astype(np.float32)
    labels = language.viterbi(scores, text, 0.7)
    for own in (0, 2, 3):
        part = scores[text == own]
        value = lambda path: sum(part[i, p] for i, p in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(value, itertools.product(range(3), repeat=len(part))))
        assert value(labels[text == own].tolist()) == pytest.approx(best, abs=1e-4)


def test_mixed_text_has_spans(frame):
    learn = [(i, "the house and the garden with the children" if i % 2 else "der garten und das haus mit den kindern", "en" if i % 2 else "de") for i in range(20)]
    rows = [(i, t, lang, "s", 1, "x", "y", 1, "z", "w", 2) for i, t, lang in learn]
    model = language.fit(frame(rows))
    mixed = "the garden and the house with the children der garten und das haus mit den kindern"
    (row,) = language.identify(frame([(1, mixed, None, "s", 1, "x", "y", 1, "z", "w", 2)]), model, penalty=4).collect()
    assert [s["lang"] for s in row["spans"]] == ["en", "de"]
    assert mixed[row["spans"][1]["start"] : row["spans"][1]["end"]] == mixed[mixed.index("der") :]


def test_language_odd_input(odd, none, odd_rows):
    model = language.fit(odd)
    found = language.identify(odd, model).collect()
    assert len(found) == len(odd_rows)
    by_text = {(r["doc_id"], r["lang_pred"], r["score"], len(r["spans"])) for r in found}
    assert {(0, "und", 0.0, 0), (1, "und", 0.0, 0), (2, "und", 0.0, 0)} <= by_text
    assert language.relabel(odd, model).count() == len([r for r in odd_rows if r[1] and r[1].strip()])
    empty = language.fit(none)
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == 0 and language.relabel(none, empty).count() == 0


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op7_quality_classifier"](spark, folder).toPandas()
    both = found.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97 and (held.predicted == held.quality).mean() > 0.9


def test_dual_descent_separates_and_is_optimal():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(60)]
    labels = np.array([int(7 in r or 9 in r) for r in rows])
    ratio = np.ones(40)
    weights, bias = quality.descend(rows, labels, ratio, 1.0, 400, 0)
    share = labels.mean()
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    sign = np.where(labels == 1, 1, -1)

    def objective(w, b):
        margin = np.array([w[r].sum() + b for r in rows]) * sign
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - margin)).sum()

    best = objective(weights, bias)
    assert all(objective(weights + rng.normal(scale=s, size=40), bias + rng.normal(scale=s)) > best - 1e-3 for s in (0.001, 0.01, 0.1) for _ in range(50))


def test_quality_odd_input(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    found = quality.classify(odd, model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1)}) == 1
    nobody = quality.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality.classify(odd, nobody).collect()} == {0.5}
    assert quality.classify(none, model).count() == 0 and quality.keep(none, model).count() == 0
    kept = quality.keep(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in found)
