"""Keys that own a large share of a table, and joins that keep such keys spread out.

AQE splits skewed join partitions only when nothing downstream relies on the join's partitioning.
Where a window or aggregation on the same key follows, rows of hot keys are salted instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contest_panel.session import row_count_up_to

DEFAULT_HOT_ROWS = 2_000_000
BROADCAST_KEYS = 1_000_000


def small(frame: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``frame`` with a broadcast hint if it counts at most ``limit`` rows, else as it is (an action)."""
    return F.broadcast(frame) if row_count_up_to(frame, limit) <= limit else frame


def hot_keys(frame: DataFrame, key: str, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None when there are none (an action).

    Rows are counted map-side first. There are at most total / ``hot_rows`` such keys.
    """
    counts = frame.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.filter(F.col("__n") > hot_rows).select(key)
    found = row_count_up_to(hot, BROADCAST_KEYS)
    if not found:
        return None
    return F.broadcast(hot) if found <= BROADCAST_KEYS else hot


def join_on_key(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    hot: DataFrame | None,
    spread_by: str,
    salts: int = 64,
) -> DataFrame:
    """Inner, left or semi join where ``right`` has one row per key and ``hot`` lists hot keys of ``left``.

    Rows of a hot key are spread over ``salts`` tasks by ``spread_by``; its one right row is repeated
    for each of them. Both tables are read once.
    """
    if hot is None:
        return left.join(right, key, how)
    marked = hot.withColumn("__hot", F.lit(True))
    chosen = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)
    every = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    spread = left.join(marked, key, "left").withColumn("__salt", chosen).drop("__hot")
    repeated = right.join(marked, key, "left").withColumn("__salt", every).drop("__hot")
    return spread.join(repeated, [key, "__salt"], how).drop("__salt")
