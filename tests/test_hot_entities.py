"""Splitting large histories must not change any result."""

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from contest_panel.operators import orient, panel, sequences

SPLIT = {"hot_rows": 25, "segment_rows": 13}
WHOLE = {"hot_rows": 10_000_000}


@pytest.fixture(scope="module")
def skewed(focal):
    """One participant takes a large share of the rows."""
    shared = focal.withColumn("player_tag", F.when(F.crc32("battle_key") % 3 == 0, "HOT").otherwise(F.col("player_tag")))
    others = [c for c in focal.columns if c not in ("player_tag", "battle_key")]
    one = [F.min_by(c, F.struct("result", "deck")).alias(c) for c in others]
    return shared.groupBy("player_tag", "battle_key").agg(*one).cache()


def test_the_split_happens(skewed):
    timeline = sequences.sequence_timeline(skewed, 10, **SPLIT)
    assert timeline.split
    assert timeline.rows.filter("__segment >= 0").select("__segment").distinct().count() > 5
    assert timeline.result().count() == skewed.count()


def test_running_totals(skewed):
    columns = ["player_tag", "battle_key", *[f"p_{c}" for c in sequences._RUNNING], *sequences._RUNNING]
    split = sequences.annotated(skewed, **SPLIT).result().select(*columns)
    whole = sequences.annotated(skewed, **WHOLE).result().select(*columns)
    assert as_set(split) == as_set(whole)


@pytest.mark.parametrize("continuity", sequences.CONTINUITY)
def test_examples(skewed, continuity):
    split = sequences.sequence_examples(skewed, continuity=continuity, **SPLIT)
    whole = sequences.sequence_examples(skewed, continuity=continuity, **WHOLE)
    assert as_set(split) == as_set(whole)


@pytest.mark.parametrize("continuity", sequences.CONTINUITY)
def test_contexts(skewed, continuity):
    split = sequences.prebattle_contexts(skewed, continuity=continuity, **SPLIT)
    whole = sequences.prebattle_contexts(skewed, continuity=continuity, **WHOLE)
    assert as_set(split) == as_set(whole)
    assert whole.count() > 0 or continuity == "same_collection"


def test_window_counts(skewed):
    split = sequences.window_counts(skewed, continuity="same_collection", **SPLIT)
    whole = sequences.window_counts(skewed, continuity="same_collection", **WHOLE)
    assert as_set(split) == as_set(whole)


def test_panel(season):
    melted = orient.melt_sides(orient.ladder_only(season))
    melted = melted.withColumn("tag", F.when(F.crc32("pairing") % 3 == 0, "HOT").otherwise(F.col("tag")))
    melted = melted.withColumn("pairing", F.concat_ws("|", "pairing", "won"))
    split = panel.player_panel(melted, **SPLIT)
    whole = panel.player_panel(melted, **WHOLE)
    assert as_set(split) == as_set(whole)
    assert as_set(panel.transitions(melted, **SPLIT)) == as_set(panel.transitions(melted, **WHOLE))


def test_hot_keys_in_joins(spark, skewed):
    from contest_panel.operators import dedup
    from contest_panel.operators.skew import hot_keys, join_on_key

    sizes = skewed.groupBy("player_tag").agg(F.count("*").alias("battles"))
    hot = hot_keys(skewed, "player_tag", 100)
    assert [r[0] for r in hot.collect()] == ["HOT"] and hot_keys(skewed, "player_tag", 10**9) is None
    rows = skewed.select("player_tag", "battle_key")
    for how in ("inner", "left", "left_semi"):
        assert as_set(join_on_key(rows, sizes, "player_tag", how, hot, "battle_key")) == as_set(rows.join(sizes, "player_tag", how))
    eligible = sizes.filter("battles >= 40").withColumnRenamed("player_tag", "tag")
    split = dedup.rows_of_eligible(rows, eligible, hot_rows=100)
    assert as_set(split) == as_set(dedup.rows_of_eligible(rows, eligible))


def test_dataset_with_a_hot_participant(skewed):
    from contest_panel.plans import dataset

    split = dataset.sequence_dataset(skewed, hot_rows=100)
    whole = dataset.sequence_dataset(skewed)
    assert as_set(split) == as_set(whole)
    assert as_set(dataset.example_audit(split)) == as_set(dataset.example_audit(whole))
