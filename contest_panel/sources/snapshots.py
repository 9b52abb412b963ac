"""Tables kept as versions: rows in hash buckets, a version is a list of bucket files.

    base/data/<version>-<write>/bucket=<b>/…   files of the buckets that a version rewrote
    base/versions/v=<version>                 manifest: one row per bucket with its folder and row count

A new version takes over the entries of all buckets it does not touch, so what a batch writes follows the batch and not the
table. A version exists once its manifest does (Spark commits it as one file); a batch that runs again finds it and
writes nothing. Folders that no kept version names are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contest_panel.session import stored
from contest_panel.sources.season import path_exists, remove_path

BUCKETS = 64
_MANIFEST = "bucket int, folder string, rows long"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class SnapshotTable:
    """A versioned table with rows placed by a hash of ``keys``. ``buckets`` bounds the manifest's length."""

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.base, self.keys, self.buckets = spark, base, list(keys), buckets

    def exists(self, version: int) -> bool:
        return path_exists(self.spark, f"{self.base}/versions/v={version}/_SUCCESS")

    def manifest(self, version: int) -> list[tuple[int, str, int]]:
        """(bucket, folder, rows) of a version, at most one per bucket (an action)."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.base}/versions/v={version}").collect()
        return sorted((r["bucket"], r["folder"], r["rows"]) for r in rows)

    def read(self, version: int, only: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of a version, or of some of its buckets; other buckets' files are not opened. None if there are no files."""
        folders = [f"{self.base}/data/{folder}/bucket={b}" for b, folder, n in self.manifest(version) if n and (only is None or b in set(only))]
        return self.spark.read.parquet(*folders) if folders else None

    def create(self, rows: DataFrame, version: int = 0) -> None:
        """The first version: all rows."""
        if not self.exists(version):
            self._write(rows, version, [])

    def update(self, version: int, changes: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame | None]) -> None:
        """Version ``version + 1``: ``merge`` (rows so far, changes) of each bucket that has changes. Runs actions.

        ``merge`` sees whole touched buckets (None if they are empty) and returns rows of these buckets only, or None for no rows.
        """
        if self.exists(version + 1):
            return
        placed = stored(changes.withColumn("__bucket", bucket_of(self.keys, self.buckets)))
        touched = [r[0] for r in placed.select("__bucket").distinct().collect()]  # at most ``buckets`` numbers
        before = self.manifest(version) if self.exists(version) else []
        known = self.read(version, touched) if before else None
        self._write(merge(known, placed.drop("__bucket")), version + 1, [e for e in before if e[0] not in set(touched)])

    def _write(self, rows: DataFrame | None, version: int, kept: list[tuple[int, str, int]]) -> None:
        made: list[tuple[int, str, int]] = []
        if rows is not None:
            folder = f"{version}-{uuid.uuid4().hex[:12]}"
            path = f"{self.base}/data/{folder}"
            placed = rows.withColumn("bucket", bucket_of(self.keys, self.buckets))
            placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
            counts = self.spark.read.schema(placed.schema).parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
            made = [(r["bucket"], folder, r["n"]) for r in counts]
        manifest = self.spark.createDataFrame([*kept, *made], _MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/versions/v={version}")

    def keep_from(self, version: int) -> None:
        """Delete the version before ``version`` and the folders that only it names (actions)."""
        old = version - 1
        if old < 0 or not self.exists(old):
            return
        used: set[str] = set()
        later = version
        while self.exists(later):
            used |= {folder for _, folder, _ in self.manifest(later)}
            later += 1
        for folder in {folder for _, folder, _ in self.manifest(old)} - used:
            remove_path(self.spark, f"{self.base}/data/{folder}")
        remove_path(self.spark, f"{self.base}/versions/v={old}")
