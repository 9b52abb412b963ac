"""Checks that return violation rows, and a helper that turns violations into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contest_panel.functions.decks import is_full_deck
from contest_panel.operators.assign import NO_FOLD
from contest_panel.operators.timeline import build_timeline


def assert_empty(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Raise with the first few violations, if any. Runs an action."""
    found = violations.limit(shown).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def split_leaks(examples: DataFrame, entity: str = "player_tag") -> DataFrame:
    """Participants in more than one split, or in more than one fold of the training split."""
    return (
        examples.groupBy(entity)
        .agg(
            F.expr("count(DISTINCT split) AS splits"),
            F.expr("count(DISTINCT CASE WHEN split = 0 THEN fold END) AS folds"),
        )
        .filter("splits > 1 OR folds > 1")
    )


def unknown_items(decks: DataFrame, dimension: DataFrame, deck: str = "deck") -> DataFrame:
    """Items the dimension lacks, with how often they occur (counted before the join)."""
    seen = decks.select(F.explode(deck).alias("card")).groupBy("card").agg(F.count(F.lit(1)).alias("observations"))
    return seen.join(dimension.select(F.col("id").alias("card")), "card", "left_anti")


def fold_rules(examples: DataFrame, folds: int = 5, score: str | None = None) -> DataFrame:
    """Counts of rows breaking a fold rule; all zero when the table is sound."""
    scored = f"{score} IS NOT NULL" if score else "split = 0"
    return examples.agg(
        F.expr(f"count_if(split <> 0 AND fold <> {NO_FOLD}) AS folds_outside_training"),
        F.expr(f"count_if(split = 0 AND (fold IS NULL OR fold NOT BETWEEN 0 AND {folds - 1})) AS training_without_fold"),
        F.expr(f"{folds} - count(DISTINCT CASE WHEN split = 0 AND fold < {folds} THEN fold END) AS uncovered_folds"),
        F.expr(f"count_if(split = 0 AND NOT ({scored})) AS training_without_score"),
        F.expr(f"count_if(split <> 0 AND ({scored})) AS scores_outside_training"),
    )


def history_violations(rows: DataFrame) -> DataFrame:
    """Bad rows of a participant-battle table: repeated keys, results other than ±1, incomplete decks,
    uneven levels and time running backwards along the arrival number ``arrival``, if there is one."""
    repeated = (
        rows.groupBy("player_tag", "battle_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .selectExpr("player_tag", "battle_key", "'repeated key' AS problem")
    )
    faults = F.expr("""filter(array(
        CASE WHEN result IS NULL OR result NOT IN (-1, 1) THEN 'bad result' END,
        CASE WHEN NOT full THEN 'incomplete deck' END,
        CASE WHEN size(levels) <> size(deck) THEN 'uneven levels' END), x -> x IS NOT NULL)""")
    bad = (
        rows.withColumn("full", is_full_deck("deck"))
        .select("player_tag", "battle_key", F.explode(faults).alias("problem"))
    )
    found = repeated.unionByName(bad)
    if "arrival" not in rows.columns:
        return found
    timeline = build_timeline(rows.select("player_tag", "battle_key", "battle_time", "arrival"), "player_tag", ["arrival"])
    earlier = F.lag("battle_time").over(timeline.window())
    backwards = timeline.on(timeline.rows.withColumn("__earlier", earlier)).result()
    return found.unionByName(
        backwards.filter("battle_time < __earlier").selectExpr("player_tag", "battle_key", "'time goes back' AS problem")
    )


def failure_guard(outcomes: DataFrame, failed: str = "failed", limit: float = 0.5) -> DataFrame:
    """Raise when more than ``limit`` of the sources failed; otherwise pass the table on."""
    total, bad = outcomes.agg(F.count(F.lit(1)), F.count_if(F.col(failed))).first()
    if bad > limit * total:
        raise RuntimeError(f"{bad} of {total} sources failed; what survived would be biased")
    return outcomes


