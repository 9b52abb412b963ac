"""Parsing, orientation, dedup, curves and items."""

import json

import numpy as np
import pytest
from conftest import as_set
from pyspark.sql import functions as F

from contest_panel.functions import decks, scalars
from contest_panel.operators import cohort, curves, dedup, dimension, itemspace, orient, quality
from contest_panel.plans import fixtures as fx
from contest_panel.sources.live import parse_json_log


def player(tag, crowns, cards=8, **extra):
    return {
        "tag": tag, "name": tag.lower(), "crowns": crowns,
        "cards": [{"id": 26000000 + i, "level": 9 - i % 3} for i in range(cards)], **extra,
    }


def parse(spark, *battles):
    rows = [(json.dumps(b), "2024-01-05 00:00:00", f"run{i}") for i, b in enumerate(battles)]
    log = spark.createDataFrame(rows, "value string, collected_at string, run_id string")
    return parse_json_log(log.withColumn("collected_at", F.to_timestamp("collected_at")))


def battle(team, opponent, time="20240101T101112.000Z", **extra):
    return {"battleTime": time, "type": "PvP", "team": team, "opponent": opponent, **extra}


def test_mirror_copies_parse_alike(spark):
    a, b = player("#B", 1), player("#A", 2, clan={"tag": "#C"}, startingTrophies=5000)
    left, right = parse(spark, battle([a], [b]), battle([b], [a])).drop("run_id").collect()
    assert left == right
    assert (left["a_tag"], left["winner"], left["label_a_win"]) == ("#A", "a", 1)
    assert left["a_trophies"] == 5000 and left["b_trophies"] is None
    assert left["a_clan"] == "#C" and left["b_clan"] is None
    assert left["battle_key"] == "20240101T101112.000Z|#A|#B"
    assert left["a_card_evo"] == [0] * 8 and left["a_support_ids"] == [] and left["a_princess_hp"] == []
    assert left["is_clean_1v1"]


def test_flagged_not_dropped(spark):
    duo = parse(spark, battle([player("#A", 1), player("#Z", 0)], [player("#B", 0), player("#C", 0)])).first()
    assert (duo["a_team_size"], duo["a_n_cards"], duo["is_clean_1v1"]) == (2, 16, False)
    assert duo["battle_key"].endswith("|#A|#B|#C|#Z")
    tie = parse(spark, battle([player("#A", 1)], [player("#B", 1)])).first()
    assert (tie["winner"], tie["label_a_win"], tie["is_clean_1v1"]) == ("tie", None, False)
    unknown = parse(spark, battle([player("#A", None)], [player("#B", 1)])).first()
    assert (unknown["winner"], unknown["label_a_win"], unknown["is_clean_1v1"]) == (None, None, False)


def test_unusable_rows_are_rejected(spark):
    nameless = player("#A", 1)
    del nameless["tag"]
    got = parse(spark, battle([], [player("#B", 1)]), {"battleTime": "x"}, battle([nameless], [player("#B", 1)]))
    assert got.count() == 0


def test_bad_time_is_null(spark):
    assert parse(spark, battle([player("#A", 1)], [player("#B", 0)], time="nonsense")).first()["battle_time"] is None


def test_dedup_variants_differ_on_dirty_first_rows(spark):
    schema = "battle_key string, collected_at int, run_id string, is_clean_1v1 boolean, label_a_win int"
    rows = spark.createDataFrame([("k", 1, "a", False, None), ("k", 2, "b", True, 1), ("k", 3, "c", True, 0)], schema)
    assert [r["run_id"] for r in dedup.clean_first(rows).collect()] == ["b"]
    assert dedup.dedup_then_clean(rows, clean_only=True).count() == 0
    assert [r["run_id"] for r in dedup.dedup_then_clean(rows).collect()] == ["a"]
    assert [r["run_id"] for r in dedup.last_per_key(rows).collect()] == ["c"]


def test_dedup_limits_groups_before_the_shuffle(parsed):
    plan = dedup.clean_first(parsed)._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[shuffle:], "no limit below the exchange"


def test_coin_is_fair_and_repeatable(season):
    one, two = orient.neutral_sides(season, 3), orient.neutral_sides(season.repartition(5), 3)
    assert as_set(one) == as_set(two)
    kept = one.join(season.select("battle_time", "a_tag"), ["battle_time", "a_tag"]).count()
    assert 0.4 < kept / season.count() < 0.6


def test_curve_symmetry(season):
    """Counting both orientations makes the curve antisymmetric around one half."""
    flipped = season.selectExpr(
        *[c for c in season.columns if c[:2] not in ("a_", "b_")], "1 - a_won AS a_won",
        *[f"{x}_{f} AS {y}_{f}" for x, y in ("ab", "ba") for f in orient.SEASON_FIELDS],
    )
    both = season.unionByName(flipped)
    counts = both.select(curves.level_gap().alias("advantage"), F.lit(0).alias("band"), "a_won").groupBy("band", "advantage").agg(
        F.count("*").alias("battles"), F.sum("a_won").alias("wins")
    )
    curve = {r["advantage"]: r["win_rate"] for r in curves.raw_curve(counts, 1).collect()}
    for advantage, rate in curve.items():
        assert rate + curve[-advantage] == pytest.approx(1.0)


def test_standardisation_uses_whole_band_weights(spark):
    cells = spark.createDataFrame(
        [(0, 1, 10, 5), (0, 2, 90, 45), (1, 1, 10, 10), (1, 2, 1, 0)], "band int, advantage int, battles long, wins long"
    )
    got = {r["advantage"]: r for r in curves.standardised_curve(cells, 1, 5).collect()}
    assert got[1]["win_rate"] == pytest.approx((100 * 0.5 + 11 * 1.0) / 111)
    assert (got[2]["win_rate"], got[2]["battles"]) == (0.5, 90)


def test_jaccard_and_drift(spark):
    row = spark.range(1).select(
        decks.jaccard_distance(F.array(*map(F.lit, (1, 2))), F.array(*map(F.lit, (2, 3)))).alias("j"),
        decks.jaccard_distance(F.expr("array()"), F.expr("array()")).alias("empty"),
        decks.drift_of(F.lit(6)).alias("d"),
        decks.packed_deck(F.expr("array(3, 1, 2)")).alias("p"),
    ).first()
    assert row["j"] == pytest.approx(2 / 3) and row["empty"] is None
    assert row["d"] == pytest.approx(0.4) and row["p"] == 1 + 2 * 128 + 3 * 128**2


def test_pmi_is_symmetric_and_matches_numpy(season):
    rows = itemspace.pmi(itemspace.cooccurrence(season)).collect()
    table = {(r["card_i"], r["card_j"]): r for r in rows}
    items = sorted({k[0] for k in table})
    counts = np.array([[table[(i, j)]["n"] if (i, j) in table else 0 for j in items] for i in items], float)
    margin = counts.sum(axis=1)
    for (i, j), r in table.items():
        assert table[(j, i)]["pmi"] == pytest.approx(r["pmi"])
        a, b = items.index(i), items.index(j)
        assert r["pmi"] == pytest.approx(np.log(counts[a, b] * counts.sum() / (margin[a] * margin[b])))


def test_svd_matches_numpy(spark, season):
    table = itemspace.pmi(itemspace.cooccurrence(season))
    universe = itemspace.item_universe(season)
    vectors, spectrum = itemspace.factorise(spark, table, universe, 8)
    items = sorted(r[0] for r in universe.collect())
    matrix = np.zeros((len(items), len(items)))
    for r in table.collect():
        matrix[items.index(r["card_i"]), items.index(r["card_j"])] = r["pmi"]
    left, singular, _ = np.linalg.svd(matrix)
    got = [r["singular_value"] for r in spectrum.orderBy("k").collect()]
    assert got == pytest.approx(list(singular[:8]), rel=1e-6)
    mine = np.array([r["vector"] for r in vectors.orderBy("card").collect()])
    # Squared row norms do not depend on signs; ties in the spectrum are avoided by the whole subspace.
    gap = [k for k in range(1, 8) if singular[k - 1] - singular[k] > 1e-6][-1]
    want = (left[:, :gap] * np.sqrt(singular[:gap]) ** 1) ** 2
    assert (mine[:, :gap] ** 2).sum(axis=1) == pytest.approx(want.sum(axis=1), abs=1e-6)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    raw = rng.normal(size=(60, 5))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(raw)], "item long, vector array<double>")
    named = spark.createDataFrame([(3,), (40,)], "item long")
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    got = itemspace.nearest_items(vectors, named, 4).collect()
    for q in (3, 40):
        order = [int(i) for i in np.argsort(-(unit @ unit[q])) if i != q][:4]
        assert [r["item"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == order


def test_neighbours_take_the_same_few_jobs_for_any_number_asked(spark):
    """No job per block of items asked for, and every item asked for has its neighbours, copies in order of their names."""
    rng = np.random.default_rng(2)
    raw = np.round(rng.normal(size=(300, 4)), 3)
    raw[100:140], raw[7] = raw[100], 0.0
    vectors = spark.createDataFrame([(f"v{i:03}", [float(x) for x in v]) for i, v in enumerate(raw)], "item string, vector array<float>")
    jobs = []
    for count in (20, 240):
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        got = itemspace.nearest_items(vectors, vectors.select("item").limit(count), 3, at_once=10).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)
    assert jobs[1] <= jobs[0] + 2
    kept = [i for i in range(300) if i != 7]
    unit = raw.astype(np.float32).astype(float)
    unit[kept] /= np.linalg.norm(unit[kept], axis=1, keepdims=True)
    for q in (i for i in kept if i < 240):
        want = sorted((i for i in kept if i != q), key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:3]
        assert [r["item"] for r in sorted((r for r in got if r["query"] == f"v{q:03}"), key=lambda r: r["rank"])] == [f"v{i:03}" for i in want]
    assert not [r for r in got if "v007" in (r["query"], r["item"])]


def test_large_dimension_takes_the_join(spark, focal):
    words = dimension.vocabulary(fx.card_dimension(spark, complete=False))
    small = dimension.encode(focal, "deck", words, "idx")
    large = dimension.map_items(focal, "deck", words, "idx", "idx", 0, row_key=["player_tag", "battle_key"], limit=10)
    pick = ["player_tag", "battle_key", "idx"]
    assert as_set(small.select(pick)) == as_set(large.select(pick))
    back = dimension.decode(small, "idx", words, "again")
    assert back.filter("exists(zip_with(deck, again, (d, a) -> a IS NOT NULL AND a <> d), x -> x)").count() == 0


def test_both_lookups_agree_without_row_key(spark):
    rows = spark.createDataFrame([(1, [5, 6, 5]), (1, [5, 6, 5]), (2, []), (3, None), (4, [9, None])], "n int, deck array<int>")
    words = spark.createDataFrame([(5, 1), (6, 2), (7, 3)], "id int, idx int")
    for default in (0, None):
        small, large = (dimension.map_items(rows, "deck", words, "idx", "got", default, limit=n) for n in (10, 1))
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    twice = words.unionByName(words.limit(1))
    for limit in (10, 1):
        with pytest.raises(ValueError, match="repeated"):
            dimension.map_items(rows, "deck", twice, "idx", "got", limit=limit)


def test_dimension_reader(spark, tmp_path):
    path = str(tmp_path / "cards.csv")
    (tmp_path / "cards.csv").write_text("id,name,rarity\n1,Knight,Common\n2,Baby Dragon,epic\n")
    cards = dimension.read_dimension(spark, path)
    assert as_set(cards) == [(1, "Knight", "common"), (2, "Baby Dragon", "epic")]
    rows = spark.createDataFrame([(2,), (3,)], "card int")
    assert as_set(dimension.named_items(rows, cards)) == [(2, "Baby Dragon"), (3, None)]
    (tmp_path / "bad.csv").write_text("id,name,rarity\n1,Knight,mythic\n")
    with pytest.raises(ValueError, match="unusable"):
        dimension.read_dimension(spark, str(tmp_path / "bad.csv"))


def test_packed_deck_refuses_large_indices(spark):
    row = spark.range(1).select(decks.packed_deck(F.expr("array(3, 200)")).alias("p"))
    with pytest.raises(Exception, match="does not fit"):
        row.collect()


def test_unknown_cards_are_an_error(spark, parsed):
    from contest_panel.plans import dataset

    with pytest.raises(ValueError, match="without a level"):
        dataset.stored_focal(parsed, fx.card_dimension(spark, complete=False))


def test_tied_stamps_give_one_survivor(spark, parsed):
    tied = parsed.withColumn("run_id", F.lit("one")).withColumn("collected_at", F.lit("2024-01-01").cast("timestamp"))
    tied = tied.withColumn("arena", F.xxhash64("a_crowns", "type", "battle_time").cast("string")).unionByName(tied)
    few, many = (dedup.first_per_key(tied.repartition(n)).select("battle_key", "arena") for n in (3, 7))
    assert as_set(few) == as_set(many)


def test_unknown_rarity_is_null(spark):
    row = spark.createDataFrame([("Epic",), ("mythic",)], "r string").select(decks.rarity_offset("r").alias("o")).collect()
    assert [r["o"] for r in row] == [5, None]


def test_tag_and_sigmoid(spark):
    row = spark.createDataFrame([(" #ab ", 1000.0), ("cd", -1000.0)], "t string, x double")
    got = row.select(scalars.normalised_tag("t").alias("t"), scalars.sigmoid("x").alias("p")).collect()
    assert [r["t"] for r in got] == ["#AB", "#CD"]
    assert got[0]["p"] == pytest.approx(1 / (1 + np.exp(-30))) and got[1]["p"] == pytest.approx(1 / (1 + np.exp(30)))


def test_top_of_the_range_closes_into_the_last_band(spark):
    row = spark.createDataFrame([(0,), (2799,), (2800,), (14000,), (99999,)], "t int")
    got = [r[0] for r in row.select(scalars.equal_width_band("t", 5)).collect()]
    assert got == [0, 0, 1, 4, 4]


def test_time_going_back_is_reported(spark):
    rows = spark.createDataFrame(
        [("p", "k1", 2, 1, 1, list(range(8)), [1] * 8), ("p", "k2", 1, 2, 1, list(range(8)), [1] * 8)],
        "player_tag string, battle_key string, t int, arrival int, result int, deck array<int>, levels array<int>",
    ).withColumn("battle_time", F.timestamp_seconds("t"))
    assert [r["problem"] for r in quality.history_violations(rows).collect()] == ["time goes back"]
    with pytest.raises(ValueError):
        quality.assert_empty(quality.history_violations(rows), "bad history")


def test_failure_guard(spark):
    rows = spark.createDataFrame([(True,), (False,)], "failed boolean")
    assert quality.failure_guard(rows).count() == 2
    with pytest.raises(RuntimeError):
        quality.failure_guard(rows.filter("failed").union(rows))


def test_value_range(spark):
    pool = spark.createDataFrame([(3,), (1,), (8,), (4,)], "trophies int")
    row = cohort.value_range(pool).first()
    assert (row["lowest"], row["median"], row["highest"]) == (1.0, 3.5, 8.0)
