"""A persistent set of keys for exact deduplication: sorted runs by hash prefix with a Bloom filter for each.

    base/runs/<batch>/prefix=<p>/…   128-bit hashes of the batch's new keys, sorted
    base/index/<batch>               one row per run and prefix: rows, smallest and largest hash, Bloom filter

A lookup hashes the batch, meets the index by prefix (a join: filters are not sent to every task), and opens only the runs
whose range and filter may hold one of its hashes. A key is known if its 128-bit hash is stored, so which keys are known
does not depend on the filters. When a prefix has more than ``MAX_RUNS`` runs all are compacted into one, so a lookup meets a bounded
number. A task holds one prefix of a run at a time: raise ``prefixes`` with the number of keys. Index rows name the batch, so a batch that runs again is recognised and writes nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contest_panel.session import ship, stored
from contest_panel.sources.season import path_exists, remove_path

PREFIXES = 64
MAX_RUNS = 8
BITS_PER_KEY, PROBES = 12, 7
_INDEX = "batch string, prefix int, rows long, low long, high long, bloom binary"


def key_hash(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit halves of a key's hash. NULL is a key like others."""
    digest = F.md5(F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return half(1), half(17)


def _slots(high: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """Bit places of hashes in a filter of ``size`` bits: one row per probe."""
    a, b = high.view(np.uint64), low.view(np.uint64) | np.uint64(1)
    return np.array([(a + np.uint64(i) * b) % np.uint64(size) for i in range(PROBES)], np.int64)


def make_filter(high: np.ndarray, low: np.ndarray) -> bytes:
    size = max(64, -(-len(high) * BITS_PER_KEY // 8) * 8)
    bits = np.zeros(size, bool)
    bits[_slots(high, low, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bloom: bytes, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; False is certain."""
    bits = np.frombuffer(bloom, np.uint8)
    slots = _slots(high, low, len(bits) * 8)
    return ((bits[slots >> 3] >> (7 - (slots & 7))) & 1).astype(bool).all(axis=0)


class KeyStore:
    """Keys of everything stored so far. All methods that look or write run actions."""

    def __init__(self, spark: SparkSession, base: str, prefixes: int = PREFIXES, max_runs: int = MAX_RUNS):
        self.spark, self.base, self.prefixes, self.max_runs = spark, base, prefixes, max_runs
        self.opened: list[tuple[str, int]] = []  # runs that the last lookup read

    def hashed(self, frame: DataFrame, key: str) -> DataFrame:
        high, low = key_hash(F.col(key))
        return frame.withColumns({"__high": high, "__low": low}).withColumn("prefix", F.pmod("__high", F.lit(self.prefixes)).cast("int"))

    def _index(self) -> DataFrame | None:
        """Index rows that are in force: of batches that were compacted into another, none."""
        if not path_exists(self.spark, f"{self.base}/index"):
            return None
        return self.spark.read.schema(_INDEX).option("recursiveFileLookup", True).parquet(f"{self.base}/index")

    def has_batch(self, batch: str) -> bool:
        return path_exists(self.spark, f"{self.base}/index/{batch}/_SUCCESS")

    def _candidates(self, hashes: DataFrame, index: DataFrame) -> list[tuple[str, int]]:
        """(batch, prefix) of the runs that may hold one of the hashes: at most prefixes × max_runs pairs."""
        ship(self.spark)

        def test(asked: pa.Table, runs: pa.Table) -> pa.Table:
            high, low = (asked.column(c).to_numpy() for c in ("__high", "__low"))
            found = []
            for run in runs.to_pylist():
                inside = (high >= run["low"]) & (high <= run["high"])
                if inside.any() and may_hold(run["bloom"], high[inside], low[inside]).any():
                    found.append((run["batch"], run["prefix"]))
            return pa.table({"batch": pa.array([b for b, _ in found], pa.string()), "prefix": pa.array([p for _, p in found], pa.int32())})

        asked = hashes.select("prefix", "__high", "__low")
        met = asked.groupBy("prefix").cogroup(index.groupBy("prefix")).applyInArrow(test, "batch string, prefix int")
        return sorted((r["batch"], r["prefix"]) for r in met.collect())

    def new_rows(self, frame: DataFrame, key: str) -> DataFrame:
        """Rows of ``frame`` (one per key) whose key is not stored. Columns as given."""
        hashes = stored(self.hashed(frame, key))
        index = self._index()
        self.opened = self._candidates(hashes, index) if index is not None else []
        if self.opened:
            runs = self.spark.read.parquet(*[f"{self.base}/runs/{b}/prefix={p}" for b, p in self.opened])
            hashes = hashes.join(runs.select("__high", "__low"), ["__high", "__low"], "left_anti")
        return hashes.select(*frame.columns)

    def add(self, batch: str, frame: DataFrame, key: str) -> None:
        """Store the keys of ``frame`` as run ``batch``; the name of a batch that was added before changes nothing."""
        if self.has_batch(batch):
            return
        self._write_run(batch, self.hashed(frame.select(key), key).select("prefix", "__high", "__low").distinct())
        self.compact()

    def _write_run(self, batch: str, hashes: DataFrame) -> None:
        ship(self.spark)
        path = f"{self.base}/runs/{batch}"
        hashes.repartition("prefix").sortWithinPartitions("prefix", "__high", "__low").write.mode("overwrite").partitionBy("prefix").parquet(path)

        def index(table: pa.Table) -> pa.Table:
            high, low = (table.column(c).to_numpy() for c in ("__high", "__low"))
            made = [[batch], [table.column("prefix")[0].as_py()], [len(high)], [int(high.min())], [int(high.max())], [make_filter(high, low)]]
            names = ("batch", "prefix", "rows", "low", "high", "bloom")
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.table([pa.array(v, k) for v, k in zip(made, kinds)], names=names)

        written = self.spark.read.schema("__high long, __low long, prefix int").parquet(path)
        written.groupBy("prefix").applyInArrow(index, _INDEX).write.mode("overwrite").parquet(f"{self.base}/index/{batch}")

    def compact(self) -> None:
        """Merge all runs into one when a prefix has more than ``max_runs``. Old runs go once the new index row stands.

        An index of the merged run with the old ones still beside it gives the same answers, so a driver lost in between does no harm.
        """
        index = self._index()
        most = index.groupBy("prefix").count().agg(F.max("count")).head()[0] if index is not None else 0
        if (most or 0) <= self.max_runs:
            return
        old = [r["batch"] for r in index.select("batch").distinct().collect()]
        whole = self.spark.read.schema("__high long, __low long").option("recursiveFileLookup", True).parquet(*[f"{self.base}/runs/{b}" for b in old])
        placed = whole.distinct().withColumn("prefix", F.pmod("__high", F.lit(self.prefixes)).cast("int"))
        self._write_run(f"merged-{uuid.uuid4().hex[:12]}", placed.select("prefix", "__high", "__low"))
        for batch in old:
            # The marker of a plain batch stays, so that it is still known when it runs again.
            if not batch.startswith("merged-"):
                self.spark.createDataFrame([], _INDEX).write.mode("overwrite").parquet(f"{self.base}/index/{batch}")
            else:
                remove_path(self.spark, f"{self.base}/index/{batch}")
            remove_path(self.spark, f"{self.base}/runs/{batch}")

    def size(self) -> int:
        index = self._index()
        return 0 if index is None else index.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
