"""Live contests → labelled sequence examples with splits, folds and an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contest_panel.operators import assign, sequences
from contest_panel.operators.dedup import clean_first
from contest_panel.operators.dimension import displayed_levels
from contest_panel.operators.orient import FOCAL_SOURCE, focal_rows
from contest_panel.operators.quality import assert_empty
from contest_panel.operators.skew import hot_keys, join_on_key
from contest_panel.session import materialise


def stored_focal(parsed: DataFrame, dimension: DataFrame) -> DataFrame:
    """Focal rows of all clean contests with displayed levels, written once (an action).

    Eligibility, splits, window counts and examples all start from these rows, so parsing and dedup
    run a single time. A card that the dimension lacks, or without a supported rarity, has no level on the
    common scale: an error, since a feature made up for it would be wrong.
    """
    rows = displayed_levels(focal_rows(clean_first(parsed.select(*FOCAL_SOURCE))), dimension, row_key=["player_tag", "battle_key"])
    stored = materialise(rows.drop("levels").withColumnRenamed("displayed", "levels"))
    assert_empty(stored.filter("exists(levels, x -> x IS NULL)").select("battle_key", "player_tag", "deck"), "cards without a level")
    return stored


def eligible_players(focal: DataFrame, minimum: int) -> DataFrame:
    return focal.groupBy("player_tag").agg(F.count(F.lit(1)).alias("battles")).filter(F.col("battles") >= minimum)


def sequence_dataset(
    focal: DataFrame,
    history: int = sequences.HISTORY,
    continuity: str = "all",
    feature_set: str = "current_deck_count",
    folds: int = 5,
    split_seed: int = assign.SPLIT_SEED,
    fold_seed: int = assign.FOLD_SEED,
    hot_rows: int = sequences.DEFAULT_HOT_ROWS,
) -> DataFrame:
    """Examples of stored focal rows with ``split`` and ``fold``. Runs actions.

    Splits are drawn over all eligible participants, before those without a window drop out; folds over
    the training participants that keep examples. Anyone with a window is eligible, so rows need no
    filter of their own. Store the result before using it more than once.
    """
    eligible = eligible_players(focal, history + 1)
    split = assign.player_split(eligible, split_seed, "player_tag").select("player_tag", "split")
    sizes = sequences.window_counts(focal, history, continuity, hot_rows).filter("windows > 0")
    sized = split.join(sizes.withColumnRenamed("windows", "examples"), "player_tag")
    placed = assign.player_folds(sized, folds, fold_seed, "player_tag").drop("examples")
    examples = sequences.sequence_examples(focal, history, continuity, feature_set, hot_rows)
    return join_on_key(examples, placed, "player_tag", "inner", hot_keys(focal, "player_tag", hot_rows), "example_id")


def example_audit(examples: DataFrame) -> DataFrame:
    """Participants, examples, switch and win rate per split and per fold, from one pass.

    A participant has one split and one fold, so counts per participant add up.
    """
    per_player = examples.groupBy("split", "fold", "player_tag").agg(
        F.expr("count(*) AS n"), F.expr("sum(next_switch) AS switches"), F.expr("sum(next_win) AS wins")
    )
    both = per_player.selectExpr(
        "*",
        "explode(filter(array("
        "named_struct('level', 'split', 'id', split),"
        f" CASE WHEN fold <> {assign.NO_FOLD} THEN named_struct('level', 'fold', 'id', fold) END), x -> x IS NOT NULL)) AS g",
    )
    return both.groupBy(F.col("g.level").alias("level"), F.col("g.id").alias("id")).agg(
        F.expr("count(*) AS players"),
        F.expr("sum(n) AS examples"),
        F.expr("sum(switches) / sum(n) AS switch_rate"),
        F.expr("sum(wins) / sum(n) AS win_rate"),
    )
