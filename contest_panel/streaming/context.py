"""The table of current contexts, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from contest_panel.operators.dedup import first_per_key
from contest_panel.operators.sequences import HISTORY, prebattle_contexts
from contest_panel.session import materialise
from contest_panel.sources.season import path_exists
from contest_panel.sources.snapshots import BUCKETS, SnapshotTable, bucket_of


def context_table(spark: SparkSession, base: str, buckets: int = BUCKETS) -> SnapshotTable:
    return SnapshotTable(spark, f"{base}/contexts", ["player_tag"], buckets)


def context_ingest(
    focal: DataFrame, base: str, checkpoint: str, history: int = HISTORY, continuity: str = "all", buckets: int = BUCKETS
) -> DataStreamWriter:
    """Keep the current pre-battle context of every participant, with the summary of the whole history.

    ``base/rows`` holds the focal rows by bucket of the participant; after batch ``n`` version ``n + 1`` of :func:`context_table` holds
    the contexts, and two versions are kept. A batch stores its new rows, rebuilds the contexts of the participants it
    touches from their stored rows (late rows find their place) and rewrites their buckets of the contexts; other buckets are
    taken over as they are. A batch that runs again finds its rows stored and its version made.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = context_table(spark, base, buckets)
        if table.exists(number + 1):
            return
        fresh = materialise(first_per_key(batch, ["player_tag", "battle_key"], ["battle_time"]).withColumn("bucket", bucket_of(["player_tag"], buckets)))
        touched = fresh.select("player_tag", "bucket").distinct()
        rows = f"{base}/rows"
        if path_exists(spark, rows):
            kept = spark.read.parquet(rows).select("bucket", "player_tag", "battle_key")
            fresh = fresh.join(kept, ["bucket", "player_tag", "battle_key"], "left_anti")
        fresh.write.mode("append").partitionBy("bucket").parquet(rows)
        # The buckets of a batch prune the stored rows while the join runs.
        held = spark.read.parquet(rows).join(touched, ["bucket", "player_tag"], "left_semi").drop("bucket")

        def merge(before: DataFrame | None, current: DataFrame) -> DataFrame:
            return current if before is None else current.unionByName(before.select(*current.columns).join(current.select("player_tag"), "player_tag", "left_anti"))

        table.update(number, prebattle_contexts(held, history, continuity), merge)
        table.keep_from(number)

    return focal.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply)
