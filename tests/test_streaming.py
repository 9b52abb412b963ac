"""Streams give what the batch plans give on the same files."""

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from contest_panel.operators import dedup, sequences
from contest_panel.sources import keystore, snapshots
from contest_panel.plans import fixtures as fx
from contest_panel.streaming import context, ingest


@pytest.fixture(scope="module")
def pages(spark, folder, tmp_path_factory):
    """The raw log as JSON files, some of them repeated copies."""
    path = str(tmp_path_factory.mktemp("pages"))
    fx.raw_log(spark, folder).drop("collected_at", "run_id").repartition(4).write.mode("append").json(path)
    return path


def drain(writer):
    running = writer.start()
    running.awaitTermination(240)
    assert not running.isActive
    if running.exception():
        raise running.exception()


def test_exact_ingest_equals_batch(spark, folder, parsed, pages, tmp_path):
    stored, mark = str(tmp_path / "stored"), str(tmp_path / "mark")
    stream = ingest.parsed_pages(ingest.read_pages(spark, pages, files_per_trigger=2))
    drain(ingest.exact_ingest(stream, stored, mark))
    columns = ["battle_key", "battle_time", "winner", "a_tag", "b_tag", "a_card_ids", "b_trophies"]
    want = dedup.first_per_key(parsed).select(columns)
    assert as_set(spark.read.parquet(stored).select(columns)) == as_set(want)
    # A batch that is run again, e.g. after a lost driver, adds nothing.
    ingest.store_new(parsed.drop("date"), stored)
    assert spark.read.parquet(stored).count() == want.count()


def test_replay_and_late_contests(spark, parsed, tmp_path):
    """Rows without a readable time are stored once however often their batch runs; late new rows are kept."""
    path = str(tmp_path / "stored")
    rows = parsed.limit(40).withColumn("battle_time", F.when(F.col("a_crowns") > 1, F.col("battle_time"))).drop("date").cache()
    keys = rows.select("battle_key").distinct().count()
    for _ in range(3):
        ingest.store_new(rows, path)
    assert spark.read.parquet(path).count() == keys
    late = rows.limit(1).withColumn("battle_key", F.lit("late")).withColumn("battle_time", F.lit("2020-01-01").cast("timestamp"))
    ingest.store_new(late, path)
    assert spark.read.parquet(path).filter("battle_key = 'late'").count() == 1


def test_running_stats_equal_batch(spark, parsed, pages, tmp_path):
    stream = ingest.running_stats(ingest.parsed_pages(ingest.read_pages(spark, pages)).withColumn("run_id", F.lit("all")))
    drain(
        stream.writeStream.outputMode("complete").format("memory").queryName("stats")
        .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
    )
    want = parsed.groupBy("type").agg(F.count("*").alias("seen"), F.count_if("is_clean_1v1").alias("clean"))
    assert as_set(spark.table("stats").select("type", "seen", "clean")) == as_set(want)


def test_cohort_counters(spark, tmp_path):
    base, source = str(tmp_path / "cohort"), str(tmp_path / "polls")
    start = spark.createDataFrame(
        [("A", None, 0, 0, 0), ("B", None, 2, 5, 1)],
        "tag string, last_polled timestamp, n_polls bigint, n_battles bigint, n_fail bigint",
    )
    ingest.cohort_table(spark, base).create(start)
    polls = spark.createDataFrame([("A", 1_700_000_000, 7), ("B", None, 0)], "tag string, at bigint, kept bigint").select(
        "tag", F.timestamp_seconds("at").alias("polled_at"), "kept"
    )
    polls.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(polls.schema).parquet(source)
    drain(ingest.cohort_ingest(stream, base, str(tmp_path / "mark")))
    after = ingest.cohort_table(spark, base).read(1)
    got = {r["tag"]: r for r in after.collect()}
    assert (got["A"]["n_polls"], got["A"]["n_battles"], got["A"]["n_fail"]) == (1, 7, 0)
    assert (got["B"]["n_polls"], got["B"]["n_battles"], got["B"]["n_fail"]) == (2, 5, 2)
    assert as_set(dedup.upsert_poll_state(start, polls)) == as_set(after)


def test_statistics_of_the_ingest_equal_batch(spark, folder, pages, tmp_path):
    """Every count of the batch statistics, with copies in later files, unusable rows and filtered types."""
    from contest_panel.operators import cohort

    types = ["click", "view", "purchase"]
    stored, stats = str(tmp_path / "stored"), str(tmp_path / "stats")
    again = str(tmp_path / "again")
    raw = spark.read.schema(ingest.raw_schema()).json(pages)
    broken = raw.limit(7).withColumn("team", F.expr("slice(team, 1, 0)"))
    raw.unionByName(broken).unionByName(raw.limit(20)).repartition(6).write.json(again)
    stream = ingest.read_pages(spark, again, files_per_trigger=2).withColumns({"run_id": F.lit("all"), "collected_at": F.lit("2024-02-01").cast("timestamp")})
    drain(ingest.ingest_with_stats(stream, stored, stats, str(tmp_path / "mark"), types))
    got = spark.read.parquet(stats).groupBy("run_id", "type").agg(*[F.sum(c).alias(c) for c in ("seen", "filtered", "unparseable", "new", "duplicate", "clean")])
    every = spark.read.schema(ingest.raw_schema()).json(again).withColumns({"run_id": F.lit("all"), "collected_at": F.lit("2024-02-01").cast("timestamp")})
    log = ingest.parse_battles(every).select("run_id", "type", "battle_key", "is_clean_1v1", "collected_at")
    bad = every.filter(f"NOT coalesce({ingest.IDENTIFIED}, false)").selectExpr("run_id", "type", "cast(NULL AS string) AS battle_key", "false AS is_clean_1v1", "collected_at")
    want = cohort.run_stats(log.unionByName(bad), log.select("battle_key").limit(0), types)
    assert as_set(got) == as_set(want.select(got.columns))
    assert spark.read.parquet(stored).select("battle_key").distinct().count() == spark.read.parquet(stored).count() == sum(r["new"] for r in want.collect())


def test_repeated_polls_and_old_versions(spark, tmp_path):
    base, source = str(tmp_path / "cohort"), str(tmp_path / "polls")
    start = spark.createDataFrame([("A", None, 0, 0, 0)], "tag string, last_polled timestamp, n_polls bigint, n_battles bigint, n_fail bigint")
    ingest.cohort_table(spark, base).create(start)
    rows = spark.createDataFrame([("A", 1, 2), ("A", 5, 3), ("A", None, 9)], "tag string, at bigint, kept bigint").select("tag", F.timestamp_seconds("at").alias("polled_at"), "kept")
    for _ in range(3):
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    drain(ingest.cohort_ingest(stream, base, str(tmp_path / "mark")))
    (last,) = ingest.cohort_table(spark, base).read(3).collect()
    assert (last["n_polls"], last["n_battles"], last["n_fail"]) == (6, 15, 3)
    assert sorted(p.name for p in (tmp_path / "cohort" / "versions").iterdir()) == ["v=2", "v=3"]
    assert len(list((tmp_path / "cohort" / "data").iterdir())) == 2


def test_current_contexts_equal_batch(spark, focal, tmp_path):
    """Contexts after several batches, with late and repeated rows, are those of one batch over everything."""
    source, base = str(tmp_path / "focal"), str(tmp_path / "base")
    few = focal.filter("crc32(cast(player_tag AS binary)) % 3 = 0").cache()
    part = F.crc32(F.col("battle_key").cast("binary")) % 3
    for n in (2, 0, 1):
        few.filter(part == n).unionByName(few.filter((part == 2) & (n == 1))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(few.schema).option("maxFilesPerTrigger", 1).parquet(source)
    drain(context.context_ingest(stream, base, str(tmp_path / "mark"), buckets=4))
    versions = sorted(p.name for p in (tmp_path / "base" / "contexts" / "versions").iterdir())
    assert versions == ["v=2", "v=3"]
    got = context.context_table(spark, base, 4).read(3)
    want = sequences.prebattle_contexts(few, continuity="all")
    assert got.count() > 3 and as_set(got) == as_set(want.select(got.columns))


def test_updates_rewrite_only_touched_buckets(spark, tmp_path):
    base = tmp_path / "table"
    table = snapshots.SnapshotTable(spark, str(base), ["k"], 16)
    table.create(spark.range(2000).selectExpr("id AS k", "0L AS v"))
    changed = spark.createDataFrame([(5, 1), (77, 1), (5000, 1)], "k long, v long")

    def merge(before, changes):
        return changes if before is None else before.join(changes.select("k"), "k", "left_anti").unionByName(changes)

    folders = lambda: {p.name for p in (base / "data").iterdir()}
    first = folders()
    table.update(0, changed, merge)
    (new,) = folders() - first
    touched = {p.name for p in (base / "data" / new).iterdir() if p.is_dir()}
    assert 1 <= len(touched) <= 3
    assert as_set(table.read(1)) == as_set(merge(table.read(0), changed)) and table.read(0).count() == 2000
    table.update(0, changed, merge)  # runs again: nothing is written
    assert folders() == first | {new}
    only = [b for b, folder, _ in table.manifest(1) if folder == new]
    assert table.read(1, only).filter("k IN (5, 77, 5000)").count() == 3 and all(new in f for f in table.read(1, only).inputFiles())
    for version in (1, 2):
        table.update(version, changed, merge)
        table.keep_from(version)
    assert table.exists(3) and table.exists(2) and not table.exists(1) and as_set(table.read(3)) == as_set(table.read(2))
    table.update(3, changed.limit(0), merge)
    assert table.manifest(4) == table.manifest(3)


def test_key_store_opens_only_runs_that_may_hold_a_key(spark, tmp_path):
    store = keystore.KeyStore(spark, str(tmp_path / "keys"), prefixes=4, max_runs=3)
    keys = lambda first, n: spark.range(first, first + n).selectExpr("concat('k', id) AS key", "id AS v")
    assert store.new_rows(keys(0, 10), "key").count() == 10 and store.opened == []
    for n in range(3):
        store.add(f"{n}", keys(n * 500, 500), "key")
    assert store.size() == 1500
    assert store.new_rows(keys(700, 1), "key").count() == 0 and [b for b, _ in store.opened] == ["1"]
    fresh = store.new_rows(keys(9000, 1), "key")
    assert fresh.count() == 1 and fresh.columns == ["key", "v"] and len(store.opened) <= 1
    mixed = keys(1400, 200).unionByName(spark.createDataFrame([(None, -1)], "key string, v long"))
    assert {r["v"] for r in store.new_rows(mixed, "key").collect()} == {*range(1500, 1600), -1}
    store.add("1", keys(100_000, 5), "key")  # the batch is known: nothing changes
    assert store.size() == 1500
    store.add("3", mixed, "key")
    index = store._index()
    assert index.groupBy("prefix").count().agg(F.max("count")).head()[0] == 1 and store.size() == 1601
    assert all(store.has_batch(str(n)) for n in range(4))
    assert store.new_rows(keys(0, 1600), "key").count() == 0 and store.new_rows(mixed, "key").count() == 0


def test_filters_never_miss():
    import numpy as np

    rng = np.random.default_rng(1)
    high, low, others = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(3))
    bloom = keystore.make_filter(high, low)
    assert keystore.may_hold(bloom, high, low).all() and keystore.may_hold(bloom, others, low).mean() < 0.02


def test_keyed_ingest_equals_batch(spark, parsed, pages, tmp_path):
    path, keys = str(tmp_path / "stored"), str(tmp_path / "keys")
    stream = ingest.parsed_pages(ingest.read_pages(spark, pages, files_per_trigger=2))
    drain(ingest.keyed_ingest(stream, path, keys, str(tmp_path / "mark")))
    drain(ingest.keyed_ingest(stream, path, keys, str(tmp_path / "again")))  # every batch is known
    want = dedup.first_per_key(parsed).select("battle_key", "battle_time", "a_tag")
    assert as_set(spark.read.parquet(path).select(want.columns)) == as_set(want)
