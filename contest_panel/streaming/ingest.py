"""Continuous ingest: raw JSON pages → parsed, deduplicated, date-partitioned contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from contest_panel.operators.dedup import first_per_key, upsert_poll_state
from contest_panel.operators.cohort import run_stats
from contest_panel.operators.orient import IDENTIFIED, parse_battles
from contest_panel.sources.keystore import KeyStore
from contest_panel.sources.live import append, of_types, raw_schema
from contest_panel.sources.season import path_exists
from contest_panel.sources.snapshots import BUCKETS, SnapshotTable


def read_pages(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Raw contests from JSON-lines files as they arrive, stamped by their file."""
    raw = spark.readStream.schema(raw_schema()).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.withColumns(
        {
            "collected_at": F.col("_metadata.file_modification_time"),
            "run_id": F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1),
        }
    )


def parsed_pages(raw: DataFrame, types: list[str] | None = None) -> DataFrame:
    return parse_battles(of_types(raw, types))


def store_new(batch: DataFrame, path: str) -> None:
    """Append the rows of a batch whose key is not stored yet; running it twice stores nothing twice.

    Both copies of a contest share its day, so only the stored days the batch touches are read: partitions are
    pruned by the batch's days while the query runs. Contests without a readable time share the NULL day.
    """
    fresh = first_per_key(batch).withColumn("date", F.to_date("battle_time")).persist()
    known = stored_keys(fresh.select("date"), path)
    kept = fresh if known is None else fresh.join(known, "battle_key", "left_anti")
    append(kept.drop("date"), path)
    fresh.unpersist()


def stored_keys(dates: DataFrame, path: str) -> DataFrame | None:
    """Keys stored on the days in ``dates`` (column date) or without a day; None if nothing is stored yet."""
    spark = dates.sparkSession
    if not path_exists(spark, path):
        return None
    kept = spark.read.parquet(path).select("date", "battle_key")
    touched = kept.join(dates.distinct(), "date", "left_semi")
    return touched.unionByName(kept.filter("date IS NULL")).select("battle_key")


def keyed_ingest(parsed: DataFrame, path: str, keys: str, checkpoint: str) -> DataStreamWriter:
    """Like :func:`exact_ingest` for keys that say nothing about the day: known ones are in a key store.

    Batch ``n`` is the folder ``b=<n>`` of ``path``, written before its keys are added. A batch that runs again before that finds the
    same rows new and overwrites its folder; after that it is known and does nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store = KeyStore(batch.sparkSession, keys)
        if store.has_batch(f"{number:012d}"):
            return
        store.new_rows(first_per_key(batch), "battle_key").write.mode("overwrite").parquet(f"{path}/b={number}")
        store.add(f"{number:012d}", batch.sparkSession.read.parquet(f"{path}/b={number}"), "battle_key")

    return parsed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply)


def exact_ingest(parsed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that keeps every key ever stored out, however late its copy arrives."""
    return (
        parsed.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: store_new(batch, path))
    )


def ingest_with_stats(
    raw: DataFrame, path: str, stats: str, checkpoint: str, types: list[str] | None = None
) -> DataStreamWriter:
    """Like :func:`exact_ingest` for raw pages, with the counts of ``cohort.run_stats`` for every batch.

    A batch writes ``b=<number>`` of ``stats`` before it stores contests, so one that runs again after it stored
    some of them keeps its first counts. Sums over batches are those of one batch over everything.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{stats}/b={number}"
        batch = batch.persist()
        parsed = parse_battles(batch)
        if not path_exists(spark, f"{own}/_SUCCESS"):
            columns = ("run_id", "type", "battle_key", "is_clean_1v1", "collected_at")
            rejected = batch.filter(f"NOT coalesce({IDENTIFIED}, false)").selectExpr(
                "run_id", "type", "cast(NULL AS string) AS battle_key", "false AS is_clean_1v1", "collected_at"
            )
            log = parsed.select(*columns).unionByName(rejected)
            known = stored_keys(parsed.select(F.to_date("battle_time").alias("date")), path)
            run_stats(log, log.select("battle_key").limit(0) if known is None else known, types).write.mode("overwrite").parquet(own)
        store_new(of_types(parsed, types), path)
        batch.unpersist()

    return raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply)


def running_stats(parsed: DataFrame) -> DataFrame:
    """Contests and clean contests per run and type, for the update or complete output mode."""
    return parsed.groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if("is_clean_1v1").alias("clean")
    )


def cohort_ingest(polls: DataFrame, base: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Apply polling results batch by batch; batch ``n`` makes version ``n + 1`` of the cohort (a ``SnapshotTable`` at ``base``).

    Version 0 is the starting cohort. Only buckets with polled members are rewritten. A batch that runs again finds its version;
    versions before its predecessor are deleted, so two are kept.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table = cohort_table(batch.sparkSession, base, buckets)
        table.update(number, batch, lambda cohort, changes: None if cohort is None else upsert_poll_state(cohort, changes))
        table.keep_from(number)

    return polls.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply)


def cohort_table(spark: SparkSession, base: str, buckets: int = BUCKETS) -> SnapshotTable:
    return SnapshotTable(spark, base, ["tag"], buckets)
