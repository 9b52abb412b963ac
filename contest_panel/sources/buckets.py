"""Tables stored by participant: rows of a key lie together, so that panels, windows and joins on it need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from contest_panel.session import checkpoint_folder

#: Bytes of a bucket file to aim for.
BUCKET_BYTES = 128_000_000


def buckets_for(size: int, least: int = 8) -> int:
    """Number of buckets for so many stored bytes: a power of two, so tables of different size still fit each other."""
    wanted = max(least, -(-size // BUCKET_BYTES))
    return 1 << (wanted - 1).bit_length()


def store_by(frame: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64, name: str | None = None, path: str | None = None) -> DataFrame:
    """``frame`` as a table bucketed by ``keys`` and sorted by ``keys`` and ``order`` inside a bucket, read back (an action).

    One shuffle places the rows, so each bucket is one file. Everything that groups, windows or joins by ``keys`` reads it without
    another; two tables of equal keys and bucket number join in place. A key with very many rows makes one large file: for
    such tables the operators' ``hot_rows`` way cuts the key into segments when it is read. NULL keys are kept.
    The table is registered in the session's catalog under ``name``; its files lie in ``path`` or the shared folder.
    """
    spark = frame.sparkSession
    name = name or f"stored_by_{uuid.uuid4().hex}"
    path = path or f"{checkpoint_folder(spark)}/{name}"
    placed = frame.repartition(buckets, *keys).sortWithinPartitions(*keys, *order)
    placed.write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def register(spark: SparkSession, name: str, path: str, like: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """A table that :func:`store_by` wrote in another session, named again; nothing is read or moved."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    listed = lambda names: ", ".join(f"`{n}`" for n in names)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet CLUSTERED BY ({listed(keys)}) "
        f"SORTED BY ({listed([*keys, *order])}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def forget(spark: SparkSession, name: str) -> None:
    """Take the table's name out of the catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def largest_bucket(table: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows per bucket number, largest first: whether a key dominates one (one row per bucket)."""
    number = F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")
    return table.groupBy(number).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "bucket")
