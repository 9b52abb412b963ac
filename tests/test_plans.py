"""The physical plans are the intended ones on stored tables."""

import re

import pytest
from conftest import as_set

from contest_panel.operators import curves, dedup, orient, panel, sequences
from contest_panel.session import materialise
from contest_panel.sources import live, season as season_files


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single)", plan))


@pytest.fixture(scope="module")
def stored_season(spark, season, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("season"))
    season_files.flat_view(season).write.mode("append").partitionBy("day").parquet(path)
    return season_files.read_days(spark, path, ["01-30"])


def test_counts_scan_only_what_they_need(stored_season):
    plan = plan_of(curves.level_counts(stored_season))
    assert shuffles(plan) == 1
    assert "PushedFilters: [In(game_mode" in plan
    scanned = plan[plan.index("FileScan parquet") :].split("]")[0]
    assert "card" not in scanned and "crowns" not in scanned and "clan" not in scanned
    assert "aggregate(" not in plan, "the level sum stays in generated code"


def test_panel_takes_one_shuffle_and_one_sort(stored_season):
    plan = plan_of(panel.player_panel(orient.melt_sides(orient.ladder_only(stored_season))))
    assert shuffles(plan) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_examples_take_one_shuffle_and_two_sorts(focal):
    plan = plan_of(sequences.sequence_examples(materialise(focal)))
    assert shuffles(plan) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 2


def test_clean_filter_reaches_the_live_scan(spark, parsed, tmp_path):
    path = str(tmp_path / "live")
    parsed.write.partitionBy("date").parquet(path)
    needed = live.read_live(spark, path, None).select("battle_key", "label_a_win", "is_clean_1v1", "collected_at", "run_id")
    plan = plan_of(dedup.clean_first(needed).select("battle_key", "label_a_win"))
    assert "EqualTo(is_clean_1v1,true)" in plan
    scanned = plan[plan.index("FileScan parquet") :].split("]")[0]
    assert "card_ids" not in scanned
    assert plan.count("WindowGroupLimit") == 2


def test_a_table_stored_by_participant_is_not_shuffled_again(spark, season, tmp_path):
    from pyspark.sql import Window, functions as F

    from contest_panel.sources import buckets

    melted = orient.melt_sides(orient.ladder_only(season))
    table = buckets.store_by(melted, ["tag"], ["battle_time", "pairing"], buckets=4, name="melted_rows", path=str(tmp_path / "t"))
    assert shuffles(plan_of(panel.player_panel(table))) == 0
    counts = table.groupBy("tag").agg(F.count("*").alias("n"))
    joined = table.hint("merge").join(counts, "tag").withColumn("first", F.min("battle_time").over(Window.partitionBy("tag")))
    assert shuffles(plan_of(joined)) == 0
    assert as_set(panel.player_panel(table)) == as_set(panel.player_panel(melted))
    assert len(list((tmp_path / "t").glob("part-*"))) <= 4
    buckets.forget(spark, "melted_rows")
    again = buckets.register(spark, "named_again", str(tmp_path / "t"), melted, ["tag"], ["battle_time", "pairing"], 4)
    assert as_set(again) == as_set(melted) and shuffles(plan_of(again.groupBy("tag").count())) == 0
    sizes = [r["rows"] for r in buckets.largest_bucket(again, ["tag"], 4).collect()]
    assert sum(sizes) == melted.count() and sizes == sorted(sizes, reverse=True)
    buckets.forget(spark, "named_again")
    assert [buckets.buckets_for(n) for n in (0, 10**9, 10**10)] == [8, 8, 128]
