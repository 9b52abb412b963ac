"""Operator 4, language identification: script ranges, per-word n-gram scores, Viterbi spans.

A model holds, for each language, log probabilities of hashed character pairs and triples inside words and
the scripts its texts use. A text is cut into words (runs of letters). The script of a word narrows the
languages it may be in; each word gets one score per language; Viterbi with a penalty for each change of
language labels the words, so a mixed text comes out as spans. The label of most letters is the language of
the text.

Counts cover every labelled row given to ``fit`` and are summed in Spark; the model itself is of a fixed
size for each language (the languages themselves are labels and must be few). Nothing is shuffled to predict.

Defined results: NULL and empty texts and texts without letters are ``und`` with score 0 and no spans, as
is every text under a model without languages; rows with NULL language are not learned from; repeated rows
count as often as they occur; equal scores go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from contest_panel.llm.common import STEP_CHARS, filter_texts, map_texts

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Code point ranges of scripts: (name, first, last), as blocks of the Unicode standard.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (0: no letter) and its script."""
    lower = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if (c := chr(point)).isalpha():
            small = c.lower()
            lower[point] = ord(small) if len(small) == 1 else point
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return lower, script


@dataclass
class Words:
    """The words of several texts, one after another."""

    pairs: np.ndarray  # bucket of each letter and its successor
    triples: np.ndarray  # bucket of each letter between its neighbours
    first: np.ndarray  # number of each word's first letter
    script: np.ndarray  # script of each word's first letter
    start: np.ndarray  # place of each word in the joined texts
    end: np.ndarray
    text: np.ndarray  # number of each word's text
    begin: np.ndarray  # place of each text in the joined texts

    @property
    def letters(self) -> np.ndarray:
        return self.end - self.start


def words(texts: list[str]) -> Words:
    lower, script = _tables()
    points = np.frombuffer("".join(f"\n{t}" for t in [*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    begin = np.cumsum([1, *[len(t) + 1 for t in texts]])
    low = lower[points]
    at = np.flatnonzero(low)
    edge = np.diff((low > 0).astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    one, two, three = low[at - 1], low[at], low[at + 1]
    mixed = two * np.uint32(2654435761) + three * np.uint32(2246822519)
    pairs = mixed >> np.uint32(16)
    triples = (mixed * np.uint32(3266489917) + one * np.uint32(668265263)) >> np.uint32(16)
    return Words(pairs, triples, np.searchsorted(at, start), script[points[start]], start, end, np.searchsorted(begin, start, side="right") - 1, begin)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pairs: np.ndarray  # BUCKETS x languages, log probabilities
    triples: np.ndarray
    scripts: np.ndarray  # scripts x languages, whether the language is written in it


def fit(frame: DataFrame, text: str = "text", lang: str = "lang", script_share: float = 0.01) -> Model:
    """Learn from all rows of ``frame``: runs one job and brings one row per language and used bucket to the driver."""
    spread = 2 * BUCKETS + len(SCRIPT_NAMES)

    def count(slices: Iterator) -> Iterator[dict]:
        totals: dict[str, np.ndarray] = {}
        for batch, texts in slices:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in set(names):
                w = words([t for t, own in zip(texts, names) if own == name])
                sums = totals.setdefault(name, np.zeros(spread, np.int64))
                sums[:BUCKETS] += np.bincount(w.pairs, minlength=BUCKETS)
                sums[BUCKETS : 2 * BUCKETS] += np.bincount(w.triples, minlength=BUCKETS)
                sums[2 * BUCKETS :] += np.bincount(w.script, minlength=len(SCRIPT_NAMES))
        for name, sums in totals.items():
            used = np.flatnonzero(sums)
            yield {"name": [name] * len(used), "bucket": used, "n": sums[used]}

    labelled = frame.filter(F.col(lang).isNotNull())
    parts = map_texts(labelled, {"name": lang}, text, "name string, bucket int, n long", count)
    rows = parts.groupBy("name", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(rows["name"])))
    counts = np.zeros((spread, len(languages)))
    counts[rows["bucket"].to_numpy(), [languages.index(n) for n in rows["name"]]] = rows["n"]

    def logs(table: np.ndarray) -> np.ndarray:
        smooth = table + 0.5
        return np.log(smooth / smooth.sum(0)).astype(np.float32)

    scripts = counts[2 * BUCKETS :]
    return Model(
        languages,
        logs(counts[:BUCKETS]),
        logs(counts[BUCKETS : 2 * BUCKETS]),
        scripts >= np.maximum(script_share * scripts.sum(0), 1e-9),
    )


def word_scores(model: Model, w: Words) -> np.ndarray:
    """One score per word and language, 0 for the best; languages not written in the word's script get the floor."""
    if not len(w.first):
        return np.zeros((0, len(model.languages)), np.float32)
    scores = np.add.reduceat(model.pairs[w.pairs] + model.triples[w.triples], w.first, axis=0)
    allowed = model.scripts[w.script]
    scores = np.where(allowed | ~allowed.any(1, keepdims=True), scores, -1e4)
    return np.maximum(scores - scores.max(1, keepdims=True), -20).astype(np.float32)


def viterbi(scores: np.ndarray, text: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word: sum of scores less ``penalty`` for each change inside a text.

    All texts advance together, longest first, so a step costs one small array operation.
    """
    total, kinds = scores.shape
    labels = np.zeros(total, np.int16)
    if not total or kinds == 1:
        return labels
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    lengths = np.diff(np.r_[starts, total])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    back = np.empty((total, kinds), np.int16)
    own = np.arange(kinds, dtype=np.int16)
    value = scores[starts].copy()
    for t in range(1, lengths[0]):
        n = active[t]
        here, at = value[:n], starts[:n] + t
        best = here.argmax(1)
        moved = here[np.arange(n), best][:, None] - penalty
        change = moved > here
        back[at] = np.where(change, best[:, None], own)
        value[:n] = np.where(change, moved, here) + scores[at]
    state = value.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def label_words(model: Model, texts: list[str], penalty: float) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their labels, and for each text the best language's number and the letters in every language."""
    w, n, kinds = words(texts), len(texts), max(1, len(model.languages))
    if not model.languages:
        return w, np.zeros(0, np.int16), np.zeros(n, int), np.zeros((n, 1))
    labels = viterbi(word_scores(model, w), w.text, penalty)
    letters = np.bincount(w.text * kinds + labels, weights=w.letters, minlength=n * kinds).reshape(n, kinds)
    return w, labels, letters.argmax(1), letters


PENALTY = 12.0


def _chars(model: Model) -> int:
    return max(100_000, STEP_CHARS * 4 // max(4, len(model.languages)))


def identify(frame: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row per row of ``frame``: key, ``lang_pred``, ``score`` (share of letters in that language), ``spans``.

    A span is (lang, start, end) in code points, end exclusive, over words of one label.
    """
    kept = frame.sparkSession.sparkContext.broadcast(model)

    def work(slices: Iterator) -> Iterator[dict]:
        m = kept.value
        for batch, texts in slices:
            w, labels, best, letters = label_words(m, texts, penalty)
            whole = letters.sum(1)
            spans: list[list[dict]] = [[] for _ in texts]
            if len(labels):
                cut = np.flatnonzero(np.r_[True, (w.text[1:] != w.text[:-1]) | (labels[1:] != labels[:-1])])
                until = np.r_[cut[1:], len(labels)] - 1
                shift = w.begin[w.text[cut]]
                for doc, label, a, b in zip(w.text[cut].tolist(), labels[cut].tolist(), (w.start[cut] - shift).tolist(), (w.end[until] - shift).tolist()):
                    spans[doc].append({"lang": m.languages[label], "start": a, "end": b})
            yield {
                "key": batch.column(0),
                "lang_pred": [m.languages[b] if full else UNKNOWN for b, full in zip(best, whole)],
                "score": letters.max(1) / np.maximum(whole, 1),
                "spans": spans,
            }

    kind = frame.schema[key].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"
    return map_texts(frame, {"key": key}, text, schema, work, _chars(model)).withColumnRenamed("key", key)


def relabel(frame: DataFrame, model: Model, text: str = "text", lang: str = "lang", penalty: float = PENALTY) -> DataFrame:
    """Rows of ``frame`` that have a language, which replaces the value of ``lang``; ``und`` rows go."""
    kept = frame.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list[str]) -> tuple[np.ndarray, dict[str, list]]:
        _, _, best, letters = label_words(kept.value, texts, penalty)
        known = letters.sum(1) > 0
        return known, {lang: [kept.value.languages[b] if k else None for b, k in zip(best, known)]}

    return filter_texts(frame, text, decide, _chars(model))
