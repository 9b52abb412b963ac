"""Per-entity behaviour panel and season audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contest_panel.functions.decks import deck_total, drift_of, shared_items
from contest_panel.functions.scalars import ratio
from contest_panel.operators.ranking import exact_quantiles
from contest_panel.operators.skew import DEFAULT_HOT_ROWS
from contest_panel.operators.timeline import Timeline, build_timeline

PANEL_ORDER = ("battle_time", "pairing")
SUMMARY_METRICS = (
    "battles", "win_rate", "distinct_decks", "top_deck_share", "switch_rate", "switch_after_loss",
    "switch_after_win", "loss_reactivity", "switch_drift", "level_mean", "level_gain", "trophy_gain",
)


def panel_timeline(melted: DataFrame, hot_rows: int = DEFAULT_HOT_ROWS, segment_rows: int | None = None) -> Timeline:
    return build_timeline(melted, "tag", PANEL_ORDER, halo=1, hot_rows=hot_rows, segment_rows=segment_rows)


def with_transitions(timeline: Timeline) -> Timeline:
    """Add previous deck and result, ``follows``, ``switched`` and ``drift``; one sort for all."""
    step = timeline.window()
    previous = timeline.rows.withColumns(
        {"previous_deck": F.lag("deck").over(step), "previous_won": F.lag("won").over(step)}
    )
    follows = F.col("previous_deck").isNotNull()
    switched = follows & (F.col("deck") != F.col("previous_deck"))
    drift = F.when(switched, drift_of(shared_items("deck", "previous_deck")))
    return timeline.on(previous.withColumns({"follows": follows, "switched": switched, "drift": drift}))


def transitions(melted: DataFrame, hot_rows: int = DEFAULT_HOT_ROWS, segment_rows: int | None = None) -> DataFrame:
    return with_transitions(panel_timeline(melted, hot_rows, segment_rows)).result()


def player_panel(melted: DataFrame, hot_rows: int = DEFAULT_HOT_ROWS, segment_rows: int | None = None) -> DataFrame:
    """One row per participant with the behaviour measures.

    Rows are first reduced per (tag, deck), which also yields deck counts, then per tag. Only
    fixed-width sums are kept, so both steps are hash aggregations with map-side partials.
    """
    steps = with_transitions(panel_timeline(melted, hot_rows, segment_rows))
    # A split participant has a first row without predecessor only in its true first segment, but
    # "no successor" also holds at the end of every segment; the order sum settles which one is last.
    rows = steps.rows.withColumn("__next", F.lead("won").over(steps.window()))
    rows = steps.on(rows).result()
    follows, switched = F.col("follows"), F.col("switched").cast("int")

    def when_sum(condition: Column, value: str | Column, name: str) -> Column:
        return F.sum(F.when(condition, value)).alias(name)

    at_start, at_end = ~follows, F.col("__next").isNull()
    after_loss, after_win = follows & (F.col("previous_won") == 0), follows & (F.col("previous_won") == 1)
    end_micros = F.when(at_end, F.unix_micros("battle_time"))
    per_deck = rows.groupBy("tag", "deck").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("won").alias("won"),
        F.sum("total_level").alias("level_sum"),
        F.max("total_level").alias("level_max"),
        when_sum(at_start, F.col("total_level"), "level_first"),
        when_sum(at_start, F.col("trophies"), "trophies_first"),
        F.max(F.struct(end_micros.alias("at"), "pairing", "total_level", "trophies")).alias("ending")
        if steps.split
        else F.struct(
            F.lit(None).cast("bigint").alias("at"),
            F.lit(None).cast("string").alias("pairing"),
            when_sum(at_end, F.col("total_level"), "total_level"),
            when_sum(at_end, F.col("trophies"), "trophies"),
        ).alias("ending"),
        when_sum(follows, F.lit(1), "follows"),
        when_sum(follows, switched, "switches"),
        when_sum(after_loss, F.lit(1), "loss_n"),
        when_sum(after_loss, switched, "loss_switches"),
        when_sum(after_win, F.lit(1), "win_n"),
        when_sum(after_win, switched, "win_switches"),
        F.sum("drift").alias("drift_sum"),
        F.count("drift").alias("drift_n"),
    )
    if steps.split:
        last = F.max("ending").alias("ending")
    else:
        last = F.struct(
            F.sum("ending.total_level").alias("total_level"), F.sum("ending.trophies").alias("trophies")
        ).alias("ending")
    per_tag = per_deck.groupBy("tag").agg(
        F.sum("n").alias("battles"),
        F.count(F.lit(1)).alias("distinct_decks"),
        F.max("n").alias("top"),
        *[
            F.sum(c).alias(c)
            for c in (
                "won", "level_sum", "level_first", "trophies_first", "follows", "switches",
                "loss_n", "loss_switches", "win_n", "win_switches", "drift_sum", "drift_n",
            )
        ],
        F.max("level_max").alias("level_max"),
        last,
    )
    rate = lambda a, b: ratio(F.col(a), F.col(b))
    panel = per_tag.select(
        "tag",
        "battles",
        rate("won", "battles").alias("win_rate"),
        "distinct_decks",
        rate("level_sum", "battles").alias("level_mean"),
        "level_first",
        F.col("ending.total_level").alias("level_last"),
        "level_max",
        "trophies_first",
        F.col("ending.trophies").alias("trophies_last"),
        rate("top", "battles").alias("top_deck_share"),
        rate("switches", "follows").alias("switch_rate"),
        rate("loss_switches", "loss_n").alias("switch_after_loss"),
        rate("win_switches", "win_n").alias("switch_after_win"),
        rate("drift_sum", "drift_n").alias("switch_drift"),
    )
    return panel.withColumns(
        {
            "loss_reactivity": F.col("switch_after_loss") - F.col("switch_after_win"),
            "level_gain": F.col("level_last") - F.col("level_first"),
            "trophy_gain": F.col("trophies_last") - F.col("trophies_first"),
        }
    )


def panel_summary(panel: DataFrame, active_battles: int = 20, thresholds: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """Mean, sample deviation and exact quartiles of each measure among active participants, with the
    participant counts on every line. Runs an action (exact quantiles); pass a stored panel."""
    active = panel.filter(F.col("battles") >= active_battles)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in SUMMARY_METRICS])
    )
    moments = (
        active.select(pairs.alias("p"))
        .groupBy("p.metric")
        .agg(F.avg("p.value").alias("mean"), F.stddev_samp("p.value").alias("std"))
    )
    quartiles = exact_quantiles(active, SUMMARY_METRICS, (0.25, 0.5, 0.75))
    wide = quartiles.groupBy("metric").agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ]
    )
    population = panel.agg(
        F.count(F.lit(1)).alias("players"),
        *[F.count_if(F.col("battles") >= t).alias(f"players_{t}") for t in thresholds],
    )
    counts = population.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in SUMMARY_METRICS])))
    # All three sides have one row per metric.
    return moments.join(F.broadcast(wide), "metric").join(F.broadcast(counts), "metric")


def day_summary(battles: DataFrame) -> DataFrame:
    return battles.groupBy("day").agg(
        F.count(F.lit(1)).alias("battles"),
        F.min("battle_time").alias("first_battle"),
        F.max("battle_time").alias("last_battle"),
    )


def duplicate_audit(battles: DataFrame) -> DataFrame:
    """Total rows and rows beyond the first per (time, both tags)."""
    copies = battles.groupBy("battle_time", "a_tag", "b_tag").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.sum("n").alias("battles"), F.sum(F.col("n") - 1).alias("duplicates"))


def appearances(battles: DataFrame) -> DataFrame:
    """Battles per participant over both sides."""
    return (
        battles.select(F.explode(F.array("a_tag", "b_tag")).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("battles"))
    )


def activity_thresholds(battles: DataFrame, thresholds: Sequence[int] = (5, 10, 25, 50, 100)) -> DataFrame:
    """Participants and appearances at or above each threshold, with mean and exact median.

    Runs an action (exact quantiles).
    """
    sizes = appearances(battles).groupBy("battles").agg(F.count(F.lit(1)).alias("players"))
    from_size = sizes.select(
        F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), "battles", "players"
    )
    enough = F.col("battles") >= F.col("threshold")
    per_threshold = from_size.groupBy("threshold").agg(
        F.sum("players").alias("all_players"),
        (F.sum(F.col("players") * F.col("battles")) / F.sum("players")).alias("mean_battles"),
        F.coalesce(F.sum(F.when(enough, F.col("players"))), F.lit(0)).alias("players"),
        F.coalesce(F.sum(F.when(enough, F.col("players") * F.col("battles"))), F.lit(0)).alias("appearances"),
    )
    median = exact_quantiles(appearances(battles), ["battles"], [0.5]).select(
        F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), F.col("value").alias("median_battles")
    )
    return per_threshold.join(F.broadcast(median), "threshold")


def period_compare(battles: DataFrame, final_day: Column) -> DataFrame:
    """Selected period against the rest, one row per metric, from a single aggregation."""
    levels = F.expr(deck_total("a_levels"))
    both = (
        battles.withColumn("__final", final_day)
        .groupBy("__final")
        .agg(
            F.count(F.lit(1)).cast("double").alias("battles"),
            (F.sum(levels) / F.sum(F.size("a_levels"))).alias("mean_card_level"),
            F.avg("a_trophies").alias("mean_trophies"),
            F.count_distinct(F.get("a_cards", F.lit(0))).cast("double").alias("distinct_first_cards"),
        )
    )
    metrics = ("battles", "mean_card_level", "mean_trophies", "distinct_first_cards")
    lines = both.select(
        "__final", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("p")
    )
    return (
        lines.groupBy(F.col("p.metric").alias("metric"))
        .agg(
            F.max(F.when(F.col("__final"), F.col("p.value"))).alias("selected"),
            F.max(F.when(~F.col("__final"), F.col("p.value"))).alias("rest"),
        )
        .withColumn("difference", F.col("selected") - F.col("rest"))
    )
