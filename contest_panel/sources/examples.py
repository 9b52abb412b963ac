"""Stored sequence examples and cohort state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from contest_panel.sources.season import path_exists

REQUIRED = ("example_id", "player_tag", "history", "next_switch", "split")
OPTIONAL = ("next_win", "fold")
COHORT_DDL = (
    "tag string, name string, clan_tag string, clan_score bigint, trophies bigint, added_at timestamp, "
    "last_polled timestamp, n_polls bigint, n_battles bigint, n_fail bigint"
)


def write_examples(examples: DataFrame, path: str) -> None:
    """Example table partitioned by split; Spark rebalances the three uneven splits into even files."""
    (
        examples.hint("rebalance", "split")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("split")
        .parquet(path)
    )


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Stored examples; optional columns of older tables appear as NULL."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no example table under {path}")
    examples = spark.read.parquet(path)
    absent = [c for c in REQUIRED if c not in examples.columns]
    if absent:
        raise ValueError(f"example table lacks columns: {absent}")
    missing = {c: F.lit(None).cast("int") for c in OPTIONAL if c not in examples.columns}
    return examples.withColumns(missing) if missing else examples


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """Cohort state; an empty table with the fixed columns when nothing is stored."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], COHORT_DDL)
    return spark.read.parquet(path)


def write_cohort(cohort: DataFrame, path: str) -> None:
    """Store a new version beside the old ones, so the input of an update is never overwritten."""
    cohort.write.mode("errorifexists").option("compression", "zstd").parquet(path)
