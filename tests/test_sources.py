"""Round trips through CSV, Parquet and JSON files."""

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from contest_panel.operators import orient
from contest_panel.plans import fixtures as fx
from contest_panel.sources import examples as example_files
from contest_panel.sources import live, season as season_files


def wide_csv(source, day):
    """The fixture in the wide source layout."""
    columns = [F.col("battleTime"), F.col("game_mode").alias("gameMode.id"), F.col("arena").alias("arena.id"), F.lit("x").alias("unused")]
    for side in season_files.SIDES:
        for n in season_files.NUMBERS:
            columns.append(F.col(f"{side}_cards")[n - 1].alias(f"{side}.card{n}.id"))
            columns.append(F.col(f"{side}_levels")[n - 1].alias(f"{side}.card{n}.level"))
        columns += [F.col(f"{side}_{name}").alias(f"{side}.{scalar}") for scalar, name in season_files.SIDE_SCALARS.items()]
    return source.filter(F.col("day") == day).select(*columns)


@pytest.fixture(scope="module")
def csv_folder(spark, folder, tmp_path_factory):
    target = tmp_path_factory.mktemp("csv")
    source = fx.season_source(spark, folder)
    for day in ("2024-01-03", "2024-01-04"):
        rows = wide_csv(source, day).toPandas()
        rows["winner.kingTowerHitPoints"] = rows["winner.kingTowerHitPoints"].astype("float")
        rows.loc[0, "loser.card3.id"] = None
        rows.to_csv(target / f"{day}.csv", index=False)
    return str(target)


def test_csv_to_parquet_and_back(spark, folder, csv_folder, tmp_path):
    source = season_files.read_source(spark, csv_folder)
    destination = str(tmp_path / "season")
    report = {r["day"]: r for r in season_files.convert(source, destination).collect()}
    assert set(report) == {"2024-01-03", "2024-01-04"}
    assert all(r["rows_written"] == r["rows_read"] - 1 for r in report.values())
    stored = season_files.read_days(spark, destination)
    written = stored.count()
    assert written == sum(r["rows_written"] for r in report.values())
    expected = fx.season(spark, folder).select("battle_time", "a_tag", "a_cards", "b_levels", "a_king_hp", "b_clan", "a_won")
    assert set(as_set(stored.select(*expected.columns))) < set(as_set(expected))
    # Stored days are skipped, so nothing is added.
    season_files.convert(season_files.read_source(spark, csv_folder), destination)
    assert season_files.read_days(spark, destination).count() == written
    season_files.convert(season_files.read_source(spark, csv_folder), destination, force=True)
    assert season_files.read_days(spark, destination).count() == written
    kept = season_files.read_days(spark, destination, exclude=["01-04"])
    assert {str(r["day"]) for r in kept.select("day").distinct().collect()} == {"2024-01-03"}
    with pytest.raises(FileNotFoundError):
        season_files.read_days(spark, destination, exclude=["2024"])
    neutral = season_files.read_season(spark, destination, seed=5, columns=["battle_time", "a_tag", "a_won"])
    assert neutral.columns == ["battle_time", "a_tag", "a_won"]


def test_exclusion_prunes_partitions(spark, csv_folder, tmp_path):
    destination = str(tmp_path / "season")
    season_files.convert(season_files.read_source(spark, csv_folder), destination)
    plan = season_files.read_days(spark, destination, ["01-04"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [NOT" in plan


def test_missing_source_column_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("battleTime,gameMode.id\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="arena.id"):
        season_files.read_source(spark, str(tmp_path))


def test_files_have_their_own_headers_and_day_names(spark, folder, csv_folder, tmp_path):
    """Numeric day names keep their zeros, columns go by each file's header, other files are passed over."""
    import shutil

    import pandas as pd

    base = tmp_path / "tree" / "deep"
    base.mkdir(parents=True)
    shutil.copy(f"{csv_folder}/2024-01-03.csv", base / "01042021.battles.csv")
    other = pd.read_csv(f"{csv_folder}/2024-01-04.csv", dtype=str, keep_default_na=False)
    other[other.columns[::-1]].to_csv(base / "02042021.battles.csv", index=False)
    (base / "cards.csv").write_text("id,rarity\n1,common\n")
    destination = str(tmp_path / "season")
    for _ in range(2):
        source = season_files.read_source(spark, str(tmp_path / "tree"), r"battles\.csv$")
        report = {r["day"]: r["rows_written"] for r in season_files.convert(source, destination).collect()}
    assert report == {}
    stored = season_files.read_days(spark, destination)
    want = fx.season(spark, folder).filter("day in ('2024-01-03', '2024-01-04')")
    assert set(as_set(stored.select("battle_time", "a_tag", "b_cards", "a_won"))) < set(as_set(want.select("battle_time", "a_tag", "b_cards", "a_won")))
    assert {r["day"] for r in season_files.read_days(spark, destination, ["01042021"]).select("day").distinct().collect()} == {"02042021"}
    lacking = other.drop(columns=["loser.crowns"])
    lacking.to_csv(base / "03042021.battles.csv", index=False)
    with pytest.raises(ValueError, match="loser.crowns.*03042021"):
        season_files.read_source(spark, str(tmp_path / "tree"), r"battles\.csv$")


def test_flat_view_round_trip(season):
    again = season_files.from_flat_view(season_files.flat_view(season))
    assert as_set(again) == as_set(season)


def test_live_append_and_load(spark, parsed, tmp_path):
    path = str(tmp_path / "live")
    live.append(parsed.filter("run_id LIKE '%-a'").drop("date"), path)
    live.append(parsed.filter("run_id LIKE '%-b'").drop("date"), path)
    assert live.read_live(spark, path).count() == parsed.count()
    loaded = live.load_live(spark, path)
    assert loaded.count() == parsed.select("battle_key").distinct().count()
    assert loaded.filter("run_id LIKE '%-b'").count() == 0
    clean = live.load_live(spark, path, clean_only=True)
    assert clean.count() == parsed.filter("is_clean_1v1").select("battle_key").distinct().count()


def test_raw_json_files(spark, folder, parsed, tmp_path):
    raw = fx.raw_log(spark, folder)
    raw.drop("collected_at", "run_id").write.json(str(tmp_path / "raw"))
    read = live.read_raw(spark, str(tmp_path / "raw"))
    assert read.count() == raw.count()
    typed = live.of_types(read, ["click", "view"])
    assert {r["type"] for r in typed.select("type").distinct().collect()} == {"click", "view"}
    assert live.of_types(read, None).count() == read.count()
    again = orient.parse_battles(read.withColumns({"collected_at": F.current_timestamp(), "run_id": F.lit("r")}))
    columns = ["battle_key", "battle_time", "a_card_ids", "b_card_levels", "winner", "a_trophies"]
    assert as_set(again.select(columns)) == as_set(parsed.select(columns))


def test_cohort_table(spark, tmp_path):
    empty = example_files.read_cohort(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and "last_polled" in empty.columns
    path = str(tmp_path / "v1")
    row = spark.createDataFrame([("#A", 1)], "tag string, n_polls bigint")
    example_files.write_cohort(empty.unionByName(row, allowMissingColumns=True), path)
    assert example_files.read_cohort(spark, path).first()["n_polls"] == 1


def test_example_table(spark, focal, tmp_path):
    from contest_panel.operators import sequences

    examples = sequences.sequence_examples(focal).withColumn("split", F.lit(0))
    path = str(tmp_path / "examples")
    example_files.write_examples(examples.drop("next_win"), path)
    read = example_files.read_examples(spark, path)
    assert read.filter("next_win IS NOT NULL OR fold IS NOT NULL").count() == 0
    assert as_set(read.select("example_id", "history")) == as_set(examples.select("example_id", "history"))
    with pytest.raises(FileNotFoundError):
        example_files.read_examples(spark, str(tmp_path / "none"))


def test_data_source_reads_what_the_csv_reader_does(spark, csv_folder, tmp_path):
    """Own headers, other column orders, compressed and empty files; days are chosen before files are opened."""
    import gzip
    from pathlib import Path

    import pandas as pd

    from contest_panel.sources import season_scan

    for number, file in enumerate(sorted(Path(csv_folder).glob("*.csv"))):
        rows = pd.read_csv(file, dtype=str, keep_default_na=False)
        (rows if number else rows[rows.columns[::-1]]).to_csv(tmp_path / f"0{number}042021.csv.gz", index=False, compression="gzip")
    (tmp_path / "03042021.csv").write_text(rows.head(0).to_csv(index=False))
    want = season_files.read_source(spark, str(tmp_path))
    got = season_scan.scan_source(spark, str(tmp_path))
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes) and as_set(got) == as_set(want) and got.count() > 10
    some = season_scan.scan_source(spark, f"file:{tmp_path}", columns=["winner.tag", "arena.id"])
    assert some.columns == ["day", "winner.tag", "arena.id"] and some.count() == got.count()
    (tmp_path / "09042021.csv").write_text("battleTime,winner.tag\n2024-01-01,x\n")
    with pytest.raises(Exception, match=r"arena.id.*09042021"):
        season_scan.scan_source(spark, str(tmp_path)).count()
    with gzip.open(tmp_path / "08042021.csv.gz", "wb"):
        pass
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        kept = season_scan.scan_source(spark, str(tmp_path)).filter("day = '00042021'")
        assert as_set(kept) == as_set(want.filter("day = '00042021'")) and kept.count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(FileNotFoundError):
        season_scan.scan_source(spark, str(tmp_path), r"\.parquet$")


def test_files_are_grouped_for_tasks(monkeypatch, tmp_path):
    from contest_panel.sources import season_scan

    for n in range(25):
        (tmp_path / f"{n:02d}.csv").write_text("x" * (100 if n else 5000))
    monkeypatch.setattr(season_scan, "TASK_BYTES", 1000)
    monkeypatch.setattr(season_scan, "TASK_FILES", 7)
    reader = season_scan.DayReader({"path": str(tmp_path), "columns": "a"})
    parts = [p.files for p in reader.partitions()]
    assert [len(p) for p in parts] == [1, 7, 7, 7, 3] and sorted(f for p in parts for f in p) == [(f"{tmp_path}/{n:02d}.csv", f"{n:02d}") for n in range(25)]
    list(reader.pushFilters([season_scan.StringStartsWith(("day",), "1"), season_scan.EqualTo(("other",), 3)]))
    assert sorted(d for p in reader.partitions() for _, d in p.files) == [f"{n}" for n in range(10, 20)]
