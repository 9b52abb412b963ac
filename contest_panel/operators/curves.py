"""Outcome versus level advantage: counts, raw and standardised curves, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contest_panel.functions.decks import deck_total
from contest_panel.functions.scalars import (
    ADVANTAGE_LIMIT,
    BAND_COUNT,
    BAND_WIDTH,
    LADDER_MODES,
    LEVEL_BINS,
    TROPHY_DIFFERENCE_LIMIT,
    clipped,
    ratio,
)
from contest_panel.operators.orient import coin_for, ladder_only


def trophy_band() -> Column:
    both = F.col("a_trophies") + F.col("b_trophies")
    return clipped(F.floor(both / F.lit(2 * BAND_WIDTH)), 0, BAND_COUNT - 1).cast("int")


def level_gap() -> Column:
    return F.expr(f"{deck_total('a_levels')} - {deck_total('b_levels')}")


def level_counts(battles: DataFrame, seed: int | str = 0) -> DataFrame:
    """Battles and wins per (band, advantage) with coin-assigned sides: at most 80 × 81 rows."""
    staged = ladder_only(battles).select(
        trophy_band().alias("band"), level_gap().alias("__gap"), "a_won", coin_for(seed).alias("__flip")
    )
    flip = F.col("__flip")
    return (
        staged.select(
            "band",
            clipped(F.when(flip, -F.col("__gap")).otherwise(F.col("__gap")), -ADVANTAGE_LIMIT, ADVANTAGE_LIMIT)
            .cast("int")
            .alias("advantage"),
            F.when(flip, 1 - F.col("a_won")).otherwise(F.col("a_won")).alias("__won"),
        )
        .groupBy("band", "advantage")
        .agg(F.count(F.lit(1)).alias("battles"), F.sum("__won").alias("wins"))
    )


def raw_curve(counts: DataFrame, minimum_battles: int = 10_000) -> DataFrame:
    """Win rate per advantage over all battles."""
    return (
        counts.groupBy("advantage")
        .agg(F.sum("battles").alias("battles"), F.sum("wins").alias("wins"))
        .filter(F.col("battles") >= minimum_battles)
        .select("advantage", ratio(F.col("wins"), F.col("battles")).alias("win_rate"), "battles")
    )


def standardised_curve(counts: DataFrame, minimum_battles: int = 10_000, minimum_cell: int = 200) -> DataFrame:
    """Win rate per advantage averaged over bands with the table-wide band weights.

    Weights use every battle of a band; only cells with enough battles enter the average. The input
    has at most 6,480 cells, so one window over it gives the weights without a second scan.
    """
    weight = F.sum("battles").over(Window.partitionBy("band"))
    return (
        counts.withColumn("__w", weight)
        .filter(F.col("battles") >= minimum_cell)
        .groupBy("advantage")
        .agg(
            (F.sum(F.col("__w") * F.col("wins") / F.col("battles")) / F.sum("__w")).alias("win_rate"),
            F.sum("battles").alias("battles"),
        )
        .filter(F.col("battles") >= minimum_battles)
        .select("advantage", "win_rate", "battles")
    )


def with_standard_error(curve: DataFrame) -> DataFrame:
    p = F.col("win_rate")
    return curve.withColumn("standard_error", F.sqrt(p * (1 - p) / F.greatest(F.col("battles"), F.lit(1))))


def curve_report(
    counts: DataFrame, minimum_battles: int = 10_000, minimum_cell: int = 200, display_range: int = 20, items: int = 8
) -> DataFrame:
    """Both curves side by side with per-item advantage, share of battles and standard error."""
    # A curve has at most 81 rows, one per advantage, so this window and the join stay tiny.
    raw = raw_curve(counts, minimum_battles).withColumn(
        "share", F.col("battles") / F.sum("battles").over(Window.partitionBy(F.lit(0)))
    )
    matched = standardised_curve(counts, minimum_battles, minimum_cell).select(
        "advantage", F.col("win_rate").alias("standardised_win_rate")
    )
    return (
        with_standard_error(raw)
        .join(F.broadcast(matched), "advantage", "left")
        .filter(F.abs("advantage") <= display_range)
        .withColumn("per_item", F.col("advantage") / F.lit(float(items)))
    )


def level_histogram(battles: DataFrame, dimension: DataFrame) -> DataFrame:
    """Observations per (card, clipped level) over both sides; cards absent from the dimension are
    left to ``unknown_items``."""
    pairs = F.explode(
        F.concat(
            F.arrays_zip(F.col("a_cards").alias("card"), F.col("a_levels").alias("level")),
            F.arrays_zip(F.col("b_cards").alias("card"), F.col("b_levels").alias("level")),
        )
    )
    observed = (
        ladder_only(battles)
        .select(pairs.alias("p"))
        .groupBy(F.col("p.card").alias("card"), clipped("p.level", 0, LEVEL_BINS - 1).cast("int").alias("level"))
        .agg(F.count(F.lit(1)).alias("observations"))
    )
    return observed.join(dimension.select(F.col("id").alias("card")), "card", "left_semi")


def conditioning_cells(battles: DataFrame) -> DataFrame:
    """Battles per (band, stored-order gap). No outcome is read."""
    gap = clipped(level_gap(), -ADVANTAGE_LIMIT, ADVANTAGE_LIMIT).cast("int")
    return (
        ladder_only(battles)
        .select(trophy_band().alias("band"), gap.alias("gap"))
        .groupBy("band", "gap")
        .agg(F.count(F.lit(1)).alias("battles"))
    )


def difference_histogram(battles: DataFrame) -> DataFrame:
    """Battles per clipped absolute trophy difference, with rows read and kept on every line."""
    difference = clipped(F.abs(F.col("a_trophies") - F.col("b_trophies")), 0, TROPHY_DIFFERENCE_LIMIT).cast("int")
    kept = F.col("game_mode").isin(*LADDER_MODES)
    # At most 202 rows reach the window: 201 differences plus the rows outside the ladder.
    binned = (
        battles.select(F.when(kept, difference).alias("difference"))
        .groupBy("difference")
        .agg(F.count(F.lit(1)).alias("battles"))
    )
    everything = Window.partitionBy(F.lit(0))
    return binned.select(
        "difference",
        "battles",
        F.sum("battles").over(everything).alias("rows_read"),
        F.sum(F.when(F.col("difference").isNotNull(), F.col("battles"))).over(everything).alias("rows_kept"),
    ).filter("difference IS NOT NULL")
