"""Live contests: nested JSON in, date-partitioned Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from contest_panel.operators.dedup import dedup_then_clean
from contest_panel.operators.orient import parse_battles

# The fields of a raw contest that the parser reads.
PLAYER_DDL = (
    "struct<tag:string,name:string,clan:struct<tag:string>,crowns:int,kingTowerHitPoints:int,"
    "princessTowersHitPoints:array<int>,startingTrophies:int,trophyChange:int,globalRank:int,"
    "elixirLeaked:double,cards:array<struct<id:int,level:int,evolutionLevel:int>>,"
    "supportCards:array<struct<id:int>>>"
)
RAW_DDL = (
    "battleTime string, type string, gameMode struct<name:string>, arena struct<name:string>, "
    "deckSelection string, isLadderTournament boolean, isHostedMatch boolean, leagueNumber int, "
    f"eventTag string, team array<{PLAYER_DDL}>, opponent array<{PLAYER_DDL}>"
)
# The stored columns of a parsed contest, in order.
LIVE_COLUMNS = (
    "battle_key", "battle_time", "collected_at", "label_a_win", "a_tag", "b_tag", "a_crowns", "b_crowns",
    "a_trophies", "b_trophies", "a_card_ids", "b_card_ids", "a_card_levels", "b_card_levels", "is_clean_1v1",
)


def raw_schema() -> T.StructType:
    return T.StructType.fromDDL(RAW_DDL)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files of raw contests with an explicit schema (no inference pass)."""
    return spark.read.schema(raw_schema()).json(path)


def parse_json_log(log: DataFrame) -> DataFrame:
    """Parse a ``value`` JSON column, keeping ``collected_at`` and ``run_id``."""
    # The generator keeps later filters above it, so each text is parsed once, not once per predicate.
    nested = log.selectExpr("collected_at", "run_id", f"inline(array(from_json(value, '{RAW_DDL}')))")
    return parse_battles(nested)


def of_types(raw: DataFrame, types: list[str] | None) -> DataFrame:
    """Optional allow-list of contest types."""
    return raw.filter(F.col("type").isin(types)) if types else raw


def append(parsed: DataFrame, path: str, by: str = "battle_time") -> None:
    """Append parsed rows under ``date=<UTC day of by>``; the run stays a column.

    The default partitions by contest day, so both copies of a contest share a partition and dedup
    against stored keys reads only the touched days; pass ``collected_at`` for partitions by collection day.
    """
    dated = parsed.withColumn("date", F.to_date(by))
    # Rebalanced by date: small days share a task, a very large day is split.
    (
        dated.hint("rebalance", "date")
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy("date")
        .parquet(path)
    )


def read_live(spark: SparkSession, path: str, columns: tuple[str, ...] | None = LIVE_COLUMNS) -> DataFrame:
    """Stored rows; the columns of the sequence pipeline by default."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def load_live(spark: SparkSession, path: str, clean_only: bool = False) -> DataFrame:
    """All stored rows, first per key, optionally filtered to clean ones afterwards."""
    return dedup_then_clean(read_live(spark, path, None), clean_only)
