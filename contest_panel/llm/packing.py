"""Operator 3, best-fit packing of documents into sequences of bounded length.

Token ids of a document end with an end id; a document over the capacity is cut into full pieces, the first
one shorter. What the packing needs of all pieces is how many there are of each length, at most ``capacity``
numbers: the plan is made from these counts, whatever the size of the corpus. Exact-complement hashing first:
the largest length left opens a pattern, and the index of single, pair and triple sums of the lengths still
available gives what fills its gap exactly; the pattern is taken as often as the counts allow. If nothing
fills it, the largest length that fits is added and the smaller gap is looked up. Lengths whose gap can't be
filled are residuals, placed best-fit in descending order, again as counts.

A piece then needs only its rank among pieces of its length: ranks are counted in salted buckets, so a length
that holds a third of all pieces is ranked by many tasks.

Defined results: NULL and empty texts are documents of the end id alone; repeated rows and ids are documents
of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from contest_panel.llm.common import map_texts
from contest_panel.llm.graph import stored
from contest_panel.llm.tokens import byte_ids, token_file

CAPACITY = 2_048
SALTS = 64


class Counts:
    """Pieces left of each length, with the sums that singles, pairs and triples of them make."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One to three lengths available beside ``used`` that sum to ``gap``, large ones first."""
        free = self.left.copy()
        for length, n in used.items():
            free[length] -= n
        if gap < len(free) and free[gap] > 0:
            return [gap]
        if (two := self._pair(free, gap)) is not None:
            return two
        have = (free[: gap + 1] > 0).astype(np.float64)
        size = 1 << (2 * gap + 2).bit_length()
        pairs = np.fft.irfft(np.fft.rfft(have, size) ** 2, size)[: gap + 1] > 0.5  # the pair index
        third = np.flatnonzero((have > 0) & pairs[::-1])
        for c in third[::-1]:
            free[c] -= 1
            two = self._pair(free, gap - int(c))
            free[c] += 1
            if two is not None:
                return [int(c), *two]
        return None

    @staticmethod
    def _pair(free: np.ndarray, gap: int) -> list[int] | None:
        a = np.arange(1, gap // 2 + 1)
        fits = (free[a] > 0) & (free[gap - a] > 0)
        if gap % 2 == 0 and len(a) and free[gap // 2] < 2:
            fits[-1] = False
        found = np.flatnonzero(fits)
        return [gap - int(a[found[0]]), int(a[found[0]])] if len(found) else None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: copies) and how many sequences follow each; ``counts[n]`` is the number of pieces of length n."""
    stock, patterns, residual = Counts(counts), [], np.zeros(capacity + 1, np.int64)
    for largest in range(capacity, 0, -1):
        while stock.left[largest] > 0:
            pattern, gap, filled = {largest: 1}, capacity - largest, capacity == largest
            while gap and not filled:
                if (rest := stock.exact(gap, pattern)) is not None:
                    for length in rest:
                        pattern[length] = pattern.get(length, 0) + 1
                    filled = True
                    break
                fits = next((int(n) for n in np.flatnonzero(stock.left[: gap + 1])[::-1] if stock.left[n] > pattern.get(int(n), 0)), None)
                if fits is None:
                    break
                pattern[fits] = pattern.get(fits, 0) + 1
                gap -= fits
                filled = not gap
            if not filled:
                residual[largest] += stock.left[largest]
                stock.left[largest] = 0
                break
            times = min(int(stock.left[n]) // c for n, c in pattern.items())
            for n, c in pattern.items():
                stock.left[n] -= c * times
            patterns.append((pattern, times))
    return patterns + best_fit(residual, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts: equal sequences are kept as one pattern with a number."""
    by_gap: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            gap = min((g for g, open_ones in by_gap.items() if g >= length and open_ones), default=0)
            pattern, times = by_gap[gap].pop() if gap else ({}, left)
            gap = gap or capacity
            copies = min(gap // length, left)
            take = min(times, left // copies)
            if pattern and times > take:
                by_gap[gap].append((pattern, times - take))
            by_gap.setdefault(gap - copies * length, []).append((pattern | {length: pattern.get(length, 0) + copies}, take))
            left -= take * copies
    return [x for open_ones in by_gap.values() for x in open_ones]


class Places:
    """Where the piece of a length and rank goes: (sequence, offset), by binary search over the plan."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        ranks: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, times in patterns:
            offset = 0
            for length, copies in sorted(pattern.items(), reverse=True):
                first = ranks.get(length, 0)
                rows.append((length, first, sequence, copies, offset))
                ranks[length] = first + times * copies
                offset += length * copies
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.length, self.first, self.sequence, self.copies, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = (self.length << 48) + self.first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        inside = rank - self.first[at]
        return self.sequence[at] + inside // self.copies[at], self.offset[at] + inside % self.copies[at] * length


def pieces(frame: DataFrame, key: str, text: str, files: tuple[str, str | None], end: int, capacity: int) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32."""

    def work(slices: Iterator) -> Iterator[dict]:
        for batch, texts in slices:
            rows: list[tuple] = []
            for k, own in enumerate(byte_ids(texts, *files)):
                ids = np.array([*own, end], "<u4")
                cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                rows += [(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
            of, piece, start, length, crc = zip(*rows) if rows else [()] * 5
            yield {"key": batch.column(0).take(list(of)) if of else batch.column(0).slice(0, 0), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    kind = frame.schema[key].dataType.simpleString()
    return map_texts(frame, {"key": key}, text, f"key {kind}, piece int, start long, length long, ids_crc32 long", work)


def pack(
    frame: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    files: tuple[str, str | None] | None = None,
    end: int = 0,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset. Runs actions.

    ``files``: a byte-level file for ``tokenizers`` and, if there is one, its vocabulary as ranks.
    """
    files = files or (token_file("byte_bpe_50k.json"), token_file("byte_bpe_50k.tiktoken"))
    bucket = F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(SALTS))
    cut = stored(pieces(frame, key, text, files, end, capacity).withColumn("bucket", bucket))
    counted = stored(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))  # capacity x SALTS rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places = frame.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))

    before = Window.partitionBy("length").orderBy("bucket")
    offsets = counted.select("length", "bucket", (F.sum("n").over(before) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("key", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("row", F.row_number().over(inside)).join(F.broadcast(offsets), ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("place", place("length", F.col("before") + F.col("row") - 1))
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
