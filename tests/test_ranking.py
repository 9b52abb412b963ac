import numpy as np
import pytest
from pyspark.sql import functions as F

from contest_panel.operators import assign, metrics, ranking


@pytest.fixture(scope="module")
def values(spark):
    frame = spark.range(5_000).selectExpr("id", "cast(pmod(xxhash64(id), 37) AS double) AS v", "cast(id % 3 = 0 AS int) AS g")
    return frame.cache()


def test_global_rank_does_not_depend_on_partitions(values):
    few = {r["id"]: r["rank"] for r in ranking.global_rank(values, ["v", "id"], partitions=2).collect()}
    many = {r["id"]: r["rank"] for r in ranking.global_rank(values, ["v", "id"], partitions=17).collect()}
    assert few == many
    assert sorted(few.values()) == list(range(1, 5_001))


def test_running_sums(values):
    rows = ranking.running_sums(values, ["v", "id"], {"total": "id"}).orderBy("v", "id").collect()
    assert [r["total"] for r in rows] == list(np.cumsum([r["id"] for r in rows]))


def test_hashed_rank_is_dense_within_groups(values):
    rows = ranking.hashed_rank(values, ["id"], 9, within=["g"]).collect()
    for group in (0, 1):
        ranks = sorted(r["rank"] for r in rows if r["g"] == group)
        assert ranks == list(range(1, len(ranks) + 1))


def test_quantiles_match_numpy(values):
    raw = np.array([r["v"] for r in values.collect()])
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    got = {r["probability"]: r["value"] for r in ranking.exact_quantiles(values, ["v", "id"], probabilities).filter("metric = 'v'").collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(np.quantile(raw, p))


def test_quantiles_skip_nulls(spark):
    frame = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert ranking.exact_quantiles(frame, ["v"], [0.5]).first()["value"] == pytest.approx(2.5)


def brute_auc(labels, scores):
    wins = [(p > q) + 0.5 * (p == q) for p in scores[labels == 1] for q in scores[labels == 0]]
    return float(np.mean(wins))


def brute_average_precision(labels, scores):
    total, area, previous = labels.sum(), 0.0, 0.0
    for cut in sorted(set(scores), reverse=True):
        chosen = scores >= cut
        recall = labels[chosen].sum() / total
        area += (recall - previous) * labels[chosen].mean()
        previous = recall
    return float(area)


def test_ranking_metrics_match_brute_force(spark):
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 400)
    scores = np.round(np.clip(rng.normal(0.4 + 0.2 * labels, 0.2), 0.01, 0.99), 2)
    frame = spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels, scores)], "label int, score double")
    got = metrics.full_metrics(frame).first()
    assert got["roc_auc"] == pytest.approx(brute_auc(labels, scores))
    assert got["average_precision"] == pytest.approx(brute_average_precision(labels, scores))
    loss = -np.mean(labels * np.log(scores) + (1 - labels) * np.log(1 - scores))
    assert got["log_loss"] == pytest.approx(loss)
    assert got["accuracy"] == pytest.approx(np.mean((scores >= 0.5) == labels))


def test_perfect_scores_have_finite_loss(spark):
    frame = spark.createDataFrame([(1, 1.0), (0, 0.0)], "label int, score double")
    assert metrics.binary_metrics(frame).first()["log_loss"] == pytest.approx(0.0, abs=1e-9)


def test_folds_are_balanced(spark):
    sizes = spark.range(103).selectExpr("concat('P', id) AS tag", "0 AS split", "1 + id * id % 50 AS examples")
    rows = assign.player_folds(sizes, 5).groupBy("fold").agg(F.sum("examples").alias("n")).collect()
    totals = [r["n"] for r in rows]
    assert len(totals) == 5 and max(totals) - min(totals) <= 50
    with pytest.raises(ValueError):
        assign.player_folds(sizes, 1)


def test_split_sizes(spark):
    people = spark.range(1_003).selectExpr("concat('P', id) AS tag")
    sizes = {r["split"]: r["count"] for r in assign.player_split(people).groupBy("split").count().collect()}
    assert sizes == {0: 702, 1: 150, 2: 151}


def test_missing_action_is_an_error(spark):
    frame = spark.createDataFrame([(1, 0.7, 0), (0, 0.2, 0)], "label int, score double, action int")
    with pytest.raises(ValueError):
        metrics.require_actions(metrics.factual_metrics(frame, basic=True))


def test_single_run_has_zero_deviation(spark):
    lines = spark.createDataFrame([("m", 0.5)], "metric string, value double")
    assert metrics.run_aggregate(lines).first()["sd"] == 0.0
