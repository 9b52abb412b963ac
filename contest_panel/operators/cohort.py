"""Cohort bookkeeping: collection statistics and the supply of each trophy band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from contest_panel.functions.scalars import LOG_PAGE, TROPHY_CEILING, equal_width_band
from contest_panel.operators.ranking import exact_quantiles
from contest_panel.session import materialise


def run_stats(log: DataFrame, stored: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Per run and type: seen, filtered, unparseable, new, duplicate and clean contests.

    ``log``: parsed rows of the runs plus rejected ones with a NULL ``battle_key``. A key is new in the
    first row that carries it, unless already stored; keys are settled by one aggregation per key. Runs an action.
    """
    wanted = F.col("type").isin(list(types)) if types else F.lit(True)
    marked = log.select(
        "run_id", "type", "battle_key", "is_clean_1v1", "collected_at", F.coalesce(wanted, F.lit(False)).alias("wanted")
    )
    marked = materialise(marked)  # a few narrow columns, read for the winners and for the totals
    usable = marked.filter("wanted AND battle_key IS NOT NULL")
    # One row per key wins; limited per map task before the shuffle.
    first = Window.partitionBy("battle_key").orderBy("collected_at", "run_id", "type")
    winners = (
        usable.withColumn("__n", F.row_number().over(first))
        .filter("__n = 1")
        .join(stored.select("battle_key"), "battle_key", "left_anti")
        .groupBy("run_id", "type")
        .agg(F.expr("count(*) AS new"), F.expr("count_if(is_clean_1v1) AS clean"))
    )
    seen = marked.groupBy("run_id", "type").agg(
        F.expr("count(*) AS seen"),
        F.expr("count_if(NOT wanted) AS filtered"),
        F.expr("count_if(wanted AND battle_key IS NULL) AS unparseable"),
    )
    return (
        seen.join(winners, ["run_id", "type"], "left")
        .na.fill(0, ["new", "clean"])
        .withColumn("duplicate", F.expr("seen - filtered - unparseable - new"))
    )


def poll_coverage(polls: DataFrame, page: int = LOG_PAGE, alarm: float = 0.10) -> DataFrame:
    """First polls, complete and full pages on repeat polls, and whether to poll more often.

    ``polls``: run_id, n_polls before the pass, battles returned (NULL when the fetch failed).
    """
    counted = polls.groupBy("run_id").agg(
        F.expr("count_if(returned IS NULL) AS failed"),
        F.expr("count_if(returned IS NOT NULL AND n_polls = 0) AS first_polls"),
        F.expr(f"count_if(n_polls > 0 AND returned >= {page}) AS full_pages"),
        F.expr(f"count_if(n_polls > 0 AND returned < {page}) AS partial_pages"),
    )
    return counted.withColumn(
        "poll_more_often", F.expr(f"coalesce(full_pages > {alarm}D * (full_pages + partial_pages), false)")
    )


def band_supply(pool: DataFrame, target: int, bands: int = 5, value: str = "trophies") -> DataFrame:
    """Per equal-width band: available, taken, shortfall, and the balanced ceiling of the pool.

    Empty bands are listed. At most ``bands`` rows reach the windows.
    """
    width = TROPHY_CEILING / bands
    counts = pool.groupBy(equal_width_band(value, bands).alias("band")).agg(F.expr("count(*) AS n"))
    grid = pool.sparkSession.range(bands).selectExpr("cast(id AS int) AS band")
    every = Window.partitionBy(F.lit(0))
    filled = grid.join(counts, "band", "left").selectExpr(
        "band",
        f"concat(cast(cast(floor(band * {width}D) AS int) AS string), '-', "
        f"cast(cast(floor((band + 1) * {width}D) AS int) AS string)) AS label",
        "coalesce(n, 0L) AS available",
        f"least(coalesce(n, 0L), {target // bands}L) AS taken",
    )
    return filled.select(
        "band",
        "label",
        "available",
        "taken",
        (F.max("taken").over(every) - F.col("taken")).alias("shortfall"),
        (F.min("available").over(every) * bands).alias("balanced_ceiling"),
    )


def value_range(pool: DataFrame, value: str = "trophies") -> DataFrame:
    """Minimum, exact median and maximum of the pool. Runs an action."""
    wide = exact_quantiles(pool, [value], (0.0, 0.5, 1.0))
    return wide.groupBy("metric").agg(
        F.expr("max(CASE WHEN probability = 0 THEN value END) AS lowest"),
        F.expr("max(CASE WHEN probability = 0.5 THEN value END) AS median"),
        F.expr("max(CASE WHEN probability = 1 THEN value END) AS highest"),
    )
