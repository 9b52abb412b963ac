"""Per-participant sequences: transitions, windows, expanding summaries, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contest_panel.functions.decks import jaccard_distance
from contest_panel.functions.scalars import hours_between
from contest_panel.operators.skew import DEFAULT_HOT_ROWS
from contest_panel.operators.timeline import Timeline, build_timeline

HISTORY = 10
ENTITY = "player_tag"
ORDER = ("battle_time", "battle_key")
CONTINUITY = ("all", "same_collection")
# Feature order of the tables handed to models.
BATTLE_FEATURES = (
    "result", "crown_difference", "changed_deck", "switch_magnitude", "log1p_time_gap_hours", "trophies",
)
BASE_SUMMARY = (
    "historical_switch_rate", "post_loss_switch_rate", "post_win_switch_rate", "mean_switch_magnitude",
    "log1p_current_deck_tenure", "log1p_prior_battle_count", "log1p_post_loss_opportunities",
    "log1p_post_win_opportunities",
)
SUMMARY_SETS = {
    "baseline": BASE_SUMMARY,
    "current_deck_count": BASE_SUMMARY + ("log1p_current_deck_battle_count",),
}
_RUNNING = ("seq", "switches", "loss_n", "loss_switches", "win_n", "win_switches", "magnitudes", "tenure", "deck_n")


def sequence_timeline(
    focal: DataFrame, history: int = HISTORY, hot_rows: int = DEFAULT_HOT_ROWS, segment_rows: int | None = None
) -> Timeline:
    return build_timeline(focal, ENTITY, ORDER, halo=history, hot_rows=hot_rows, segment_rows=segment_rows)


def with_steps(timeline: Timeline) -> Timeline:
    """Features of the step from the previous contest; zeros where there is none."""
    step = timeline.window()
    previous = timeline.rows.withColumn(
        "__prev", F.lag(F.struct("deck", "result", "battle_time")).over(step)
    )
    known = F.col("__prev").isNotNull()
    changed = F.coalesce(F.col("deck") != F.col("__prev.deck"), F.lit(False)).cast("int")
    return timeline.on(
        previous.withColumns(
            {
                "changed_deck": changed,
                "switch_magnitude": F.when(known, jaccard_distance("deck", "__prev.deck")).otherwise(F.lit(0.0)),
                "log1p_time_gap_hours": F.when(
                    known, F.log1p(hours_between(F.col("battle_time"), F.col("__prev.battle_time")))
                ).otherwise(F.lit(0.0)),
                "previous_result": F.col("__prev.result"),
            }
        ).drop("__prev")
    )


def with_running(timeline: Timeline) -> Timeline:
    """Inclusive totals along each history: linear in its length, two sorts and one shuffle.

    The count per deck needs an order of its own and comes first; all others share the time order.
    """
    lost, won = "previous_result = -1", "previous_result = 1"
    # Placed by participant up front: that serves the windows per deck as well.
    placed = timeline.on(timeline.rows.repartition(*timeline.keys))
    counted = with_steps(placed.running({"deck_n": F.lit(1)}, per=["deck"])).running(
        {
            "seq": F.lit(1),
            "switches": "changed_deck",
            "loss_n": F.expr(f"CASE WHEN {lost} THEN 1 ELSE 0 END"),
            "loss_switches": F.expr(f"CASE WHEN {lost} THEN changed_deck ELSE 0 END"),
            "win_n": F.expr(f"CASE WHEN {won} THEN 1 ELSE 0 END"),
            "win_switches": F.expr(f"CASE WHEN {won} THEN changed_deck ELSE 0 END"),
            "magnitudes": "switch_magnitude",
        }
    )
    runs = counted.running(
        {"__run_start": F.expr("CASE WHEN changed_deck = 1 OR previous_result IS NULL THEN seq END")}, how="max"
    )
    return runs.on(runs.rows.withColumn("tenure", F.expr("seq - __run_start + 1")).drop("__run_start"))


def _summary(prefix: str) -> dict[str, str]:
    """SQL of the nine summary features from running totals stored under ``prefix``."""
    p = prefix
    return {
        "historical_switch_rate": f"CASE WHEN {p}seq > 1 THEN {p}switches / ({p}seq - 1) END",
        "post_loss_switch_rate": f"CASE WHEN {p}loss_n > 0 THEN {p}loss_switches / {p}loss_n END",
        "post_win_switch_rate": f"CASE WHEN {p}win_n > 0 THEN {p}win_switches / {p}win_n END",
        "mean_switch_magnitude": f"CASE WHEN {p}switches > 0 THEN {p}magnitudes / {p}switches END",
        "log1p_current_deck_tenure": f"log1p({p}tenure)",
        "log1p_prior_battle_count": f"log1p({p}seq)",
        "log1p_post_loss_opportunities": f"log1p({p}loss_n)",
        "log1p_post_win_opportunities": f"log1p({p}win_n)",
        "log1p_current_deck_battle_count": f"log1p({p}deck_n)",
    }


def summary_names(feature_set: str) -> tuple[str, ...]:
    if feature_set not in SUMMARY_SETS:
        raise ValueError(f"feature_set must be one of {tuple(SUMMARY_SETS)}")
    return SUMMARY_SETS[feature_set]


def _history_struct() -> Column:
    return F.struct("battle_time", "deck", "levels", *BATTLE_FEATURES)


def _reset_first(history: str) -> str:
    """The first contest of a window has no predecessor inside it."""
    return f"""transform({history}, (x, i) -> named_struct(
        'battle_time', x.battle_time, 'deck', x.deck, 'levels', x.levels, 'result', x.result,
        'crown_difference', x.crown_difference,
        'changed_deck', CASE WHEN i = 0 THEN 0 ELSE x.changed_deck END,
        'switch_magnitude', CASE WHEN i = 0 THEN 0D ELSE x.switch_magnitude END,
        'log1p_time_gap_hours', CASE WHEN i = 0 THEN 0D ELSE x.log1p_time_gap_hours END,
        'trophies', x.trophies))"""


def _one_collection(rows: str, expected: int) -> Column:
    """True when the frame columns written under ``rows`` share one non-null collection stamp."""
    return F.expr(f"{rows}_known = {expected} AND {rows}_low = {rows}_high")


def _with_collection(timeline: Timeline, back: int, name: str) -> Timeline:
    frame = timeline.window().rowsBetween(-back, 0)
    return timeline.on(
        timeline.rows.withColumns(
            {
                f"{name}_known": F.count("collected_at").over(frame),
                f"{name}_low": F.min("collected_at").over(frame),
                f"{name}_high": F.max("collected_at").over(frame),
            }
        )
    )


def check_continuity(continuity: str) -> None:
    if continuity not in CONTINUITY:
        raise ValueError(f"continuity must be one of {CONTINUITY}")


def annotated(
    focal: DataFrame, history: int = HISTORY, hot_rows: int = DEFAULT_HOT_ROWS, segment_rows: int | None = None
) -> Timeline:
    """Every contest with its step features, inclusive totals and (as ``p_*``) the totals before it."""
    if history < 1:
        raise ValueError("history must be positive")
    timeline = with_running(sequence_timeline(focal, history, hot_rows, segment_rows))
    before = timeline.rows.withColumn("__before", F.lag(F.struct(*_RUNNING)).over(timeline.window()))
    columns = {f"p_{c}": F.col(f"__before.{c}") for c in _RUNNING}
    return timeline.on(before.withColumns(columns).drop("__before"))


def sequence_examples(
    focal: DataFrame,
    history: int = HISTORY,
    continuity: str = "all",
    feature_set: str = "current_deck_count",
    hot_rows: int = DEFAULT_HOT_ROWS,
    segment_rows: int | None = None,
) -> DataFrame:
    """One row per window of ``history`` contests and the following target contest.

    The row is built on the target: history, summary of everything before it, targets. The collected
    list is bounded by the frame.
    """
    check_continuity(continuity)
    names = summary_names(feature_set)
    timeline = annotated(focal, history, hot_rows, segment_rows)
    if continuity == "same_collection":
        timeline = _with_collection(timeline, history, "__c")
    frame = timeline.window().rowsBetween(-history, -1)
    rows = timeline.on(timeline.rows.withColumn("__history", F.collect_list(_history_struct()).over(frame))).result()
    kept = rows.filter(F.col("seq") > history)
    if continuity == "same_collection":
        kept = kept.filter(_one_collection("__c", history + 1))
    summary = _summary("p_")
    return kept.selectExpr(
        "concat_ws('|', player_tag, battle_key) AS example_id",
        "player_tag",
        "battle_key",
        "battle_time AS target_time",
        "deck AS target_deck",
        f"{_reset_first('__history')} AS history",
        *[f"{summary[n]} AS {n}" for n in names],
        "changed_deck AS next_switch",
        "cast(result = 1 AS int) AS next_win",
        f"seq - {history + 1} AS window_start",
    )


def window_counts(
    focal: DataFrame,
    history: int = HISTORY,
    continuity: str = "all",
    hot_rows: int = DEFAULT_HOT_ROWS,
    segment_rows: int | None = None,
) -> DataFrame:
    """Eligible windows per participant without building them."""
    check_continuity(continuity)
    if continuity == "all":
        return focal.groupBy(ENTITY).agg(F.expr(f"greatest(count(*) - {history}, 0) AS windows"))
    timeline = _with_collection(sequence_timeline(focal, history, hot_rows, segment_rows), history, "__c")
    # A frame cut short at the start of a history has fewer known stamps, so it never qualifies.
    flagged = timeline.on(timeline.rows.withColumn("__ok", _one_collection("__c", history + 1))).result()
    return flagged.groupBy(ENTITY).agg(F.count_if("__ok").alias("windows"))


def example_at(examples: DataFrame, start: int, player: str | None = None) -> DataFrame:
    """The example whose history starts at offset ``start`` (of every participant, or of one)."""
    if start < 0:
        raise ValueError("start cannot be negative")
    chosen = examples.filter(F.col("window_start") == start)
    return chosen.filter(F.col(ENTITY) == player) if player is not None else chosen


def example_long(examples: DataFrame) -> DataFrame:
    """One line per history contest of each example."""
    return examples.select("example_id", F.posexplode("history").alias("position", "h")).select(
        "example_id", (F.col("position") + 1).alias("position"), "h.*"
    )


def prebattle_contexts(
    focal: DataFrame,
    history: int = HISTORY,
    continuity: str = "same_collection",
    feature_set: str = "current_deck_count",
    hot_rows: int = DEFAULT_HOT_ROWS,
    segment_rows: int | None = None,
) -> DataFrame:
    """Model inputs after the latest contest of each participant, without a target.

    Participants with too few contests or, when asked, a broken collection are left out.
    """
    check_continuity(continuity)
    names = summary_names(feature_set)
    timeline = with_running(sequence_timeline(focal, history, hot_rows, segment_rows))
    if continuity == "same_collection":
        timeline = _with_collection(timeline, history - 1, "__c")
    frame = timeline.window().rowsBetween(-(history - 1), 0)
    rows = timeline.rows.withColumns(
        {"__history": F.collect_list(_history_struct()).over(frame), "__next": F.lead("seq").over(timeline.window())}
    )
    # Nothing follows the latest row; of a split history each segment has such a row, the highest one counts.
    ends = timeline.on(rows).result().filter("__next IS NULL")
    if timeline.split:
        latest = Window.partitionBy(ENTITY).orderBy(F.col("seq").desc())
        ends = ends.withColumn("__nth", F.row_number().over(latest)).filter("__nth = 1")
    kept = ends.filter(F.col("seq") >= history)
    if continuity == "same_collection":
        kept = kept.filter(_one_collection("__c", history))
    summary = _summary("")
    return kept.selectExpr(
        "player_tag",
        "battle_time AS latest_time",
        f"{_reset_first('__history')} AS history",
        *[f"{summary[n]} AS {n}" for n in names],
    )
