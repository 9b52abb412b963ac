"""Paired comparisons and sparse spectra against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contest_panel.operators import itemspace, paired, spectral
from contest_panel.operators.orient import SEASON_FIELDS
from contest_panel.plans import matchup
from contest_panel.session import stored


def planted_contests(spark, players=25, games=600, seed=1):
    rng = np.random.default_rng(seed)
    skill = rng.normal(size=players)
    rows = []
    for _ in range(games):
        a, b = (int(x) for x in rng.choice(players, 2, replace=False))
        rows.append((f"p{a}", f"p{b}", int(rng.random() < 1 / (1 + np.exp(skill[b] - skill[a])))))
    return spark.createDataFrame(rows, "a_tag string, b_tag string, a_won int"), rows


def plain_ratings(rows, prior):
    names = sorted({t for r in rows for t in r[:2]})
    at = {n: i for i, n in enumerate(names)}
    r = np.zeros(len(names))
    for _ in range(500):  # Newton steps on the penalised likelihood
        slope = prior * (1 - 2 / (1 + np.exp(-r)))
        p0 = 1 / (1 + np.exp(-r))
        bend = np.diag(2 * prior * p0 * (1 - p0))
        for a, b, won in rows:
            i, j = at[a], at[b]
            p = 1 / (1 + np.exp(r[j] - r[i]))
            slope[i] += won - p
            slope[j] -= won - p
            bend[i, i] += (w := p * (1 - p))
            bend[j, j] += w
            bend[i, j] -= w
            bend[j, i] -= w
        step = np.linalg.solve(bend, slope)
        r = r + step
        if np.abs(step).max() < 1e-12:
            break
    return dict(zip(names, r))


def test_ratings_equal_a_newton_fit(spark):
    frame, rows = planted_contests(spark, 15, 300)
    noise = spark.createDataFrame([("p1", "p1", 1), (None, "p1", 1), ("p1", "p2", None)], frame.schema)
    found = paired.skill_ratings(paired.pair_counts(frame.unionByName(noise)), prior=1.0, tolerance=1e-5)
    expected = plain_ratings(rows, 1.0)
    got = {r["player"]: r["rating"] for r in found.table.collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-3) for k in got)
    fits = [f for _, f, _ in found.history]
    assert all(b >= a - 1e-9 for a, b in zip(fits, fits[1:])) and found.history[-1][2] <= 1e-5


def test_ratings_of_hot_players_take_the_salted_join(spark, monkeypatch):
    frame, rows = planted_contests(spark, 8, 60)
    pairs = stored(paired.pair_counts(frame))
    plain = {r["player"]: r["rating"] for r in paired.skill_ratings(pairs, tolerance=0.05).table.collect()}
    monkeypatch.setattr(paired, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(paired, "hot_keys", lambda f, k: spark.createDataFrame([("p1",), ("p2",)], "player string"))
    salted = {r["player"]: r["rating"] for r in paired.skill_ratings(pairs, tolerance=0.05).table.collect()}
    assert salted == pytest.approx(plain)


def plain_pav(n, wins):
    blocks = []
    for i, (a, b) in enumerate(zip(n, wins)):
        blocks.append([i, a, b])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            _, a2, b2 = blocks.pop()
            blocks[-1][1] += a2
            blocks[-1][2] += b2
    out = np.zeros(len(n))
    for k, (i, a, b) in enumerate(blocks):
        out[i : blocks[k + 1][0] if k + 1 < len(blocks) else None] = b / a
    return np.maximum(out, 0.5)


def test_isotonic_curves_by_group(spark):
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for group in "ab":
        sizes = np.arange(1, 40)
        n = rng.integers(1, 50, 39)
        wins = rng.binomial(n, 0.45 + sizes / 100)
        rows += [(group, int(s), int(a), int(b)) for s, a, b in zip(sizes, n, wins)]
        more = rng.integers(1, 9, 39)
        rows += [(group, -int(s), int(a), int(a) // 2) for s, a in zip(sizes, more)]
        expected[group] = plain_pav(n + more + 1, wins + (more - more // 2) + 0.5)
    rows += [("a", 0, 10, 7), ("a", None, 5, 5)]
    counts = spark.createDataFrame(rows, "g string, advantage int, battles long, wins long")
    found = paired.odd_isotonic(paired.mirrored_counts(counts, within=["g"]), ["g"])
    got = {(r["g"], r["size"]): r for r in found.collect()}
    for group, rates in expected.items():
        mine = [got[group, s]["block_rate"] for s in range(1, 40)]
        assert mine == pytest.approx(list(rates)) and mine == sorted(mine)
    assert got["a", 0]["log_odds"] == 0.0 and got["a", 0]["wins"] == 5.0 and ("b", 0) not in got
    assert paired.odd_isotonic(paired.mirrored_counts(counts.limit(0))).count() == 0


def deck_rows(spark, n=300, items=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(*[[int(x) for x in rng.choice(items, 4, replace=False)] for _ in "ab"], float(rng.normal()), float(rng.random() + 0.1)) for _ in range(n)]
    return spark.createDataFrame([*rows, ([1, None], None, 1.0, 1.0)], "a_cards array<int>, b_cards array<int>, r double, w double"), rows


def test_item_strengths_solve_the_equations(spark):
    frame, rows = deck_rows(spark)
    x = np.zeros((len(rows), 8))
    for line, (a, b, _, _) in zip(x, rows):
        line[a] += 1
        line[b] -= 1
    r, w = np.array([q[2] for q in rows]), np.array([q[3] for q in rows])
    expected = np.linalg.solve(x.T @ (x * w[:, None]) + 2.0 * np.eye(8), x.T @ r)
    found = {q["item"]: q["strength"] for q in paired.item_strengths(frame.filter("b_cards IS NOT NULL"), "r", "w", 2.0, tolerance=1e-9).collect()}
    assert [found[i] for i in range(8)] == pytest.approx(list(expected), abs=1e-6)


def test_factors_find_a_cycle(spark):
    """Rock, paper, scissors in a plane: two factors explain all, no strengths could."""
    rng = np.random.default_rng(4)
    angle = rng.uniform(0, 2 * np.pi, 30)
    blade, chest = np.cos(angle), np.sin(angle)
    facing = [(i, j, float(rng.integers(1, 9)), float(blade[i] * chest[j] - chest[i] * blade[j])) for i in range(30) for j in range(30) if i != j and (i + j) % 5]
    frame = spark.createDataFrame(facing, "i int, j int, n double, r double").repartition(4)
    found = paired.counter_factors(frame, rank=1, ridge=1e-3, max_rounds=15, tolerance=1e-4)
    table = {r["item"]: (np.array(r["blade"]), np.array(r["chest"])) for r in found.table.collect()}
    errors = [table[i][0] @ table[j][1] - table[i][1] @ table[j][0] - r for i, j, _, r in facing]
    assert np.sqrt(np.mean(np.square(errors))) < 0.05
    assert all(b <= a + 1e-9 for a, b in zip(found.history, found.history[1:]))


def test_facing_counts_are_antisymmetric(spark):
    frame, rows = deck_rows(spark, 50)
    got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in paired.facing_counts(frame, "r", "w").collect()}
    n, s = {}, {}
    for a, b, r, w in rows:
        for i in a:
            for j in b:
                if i != j and not (i in b and j in a):
                    for p, q, sign in ((i, j, 1), (j, i, -1)):
                        n[p, q] = n.get((p, q), 0) + w
                        s[p, q] = s.get((p, q), 0) + sign * r
    assert got.keys() == n.keys()
    assert all(got[k] == pytest.approx((n[k], s[k] / n[k])) for k in n)


def sparse_symmetric(n, density, seed):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, n)) < density, rng.normal(size=(n, n)), 0)
    return np.triu(m) + np.triu(m, 1).T


def as_entries(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], "i int, j int, value double")


def test_leading_pairs_equal_numpy(spark):
    m = sparse_symmetric(60, 0.2, 5)
    m[:, 7] = m[7, :] = 0  # a row without entries
    m += 6 * np.outer(u := np.r_[np.ones(20), np.zeros(40)], u) / 20 * (np.arange(60) != 7)[:, None] * (np.arange(60) != 7)
    found = spectral.leading(as_entries(spark, m), 5, oversampling=15)
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:5]
    assert list(found.values) == pytest.approx(list(values[order]), rel=1e-7)
    got = {r["i"]: np.array(r["vector"]) for r in found.vectors.collect()}
    mine = np.array([got.get(i, np.zeros(5)) for i in range(60)])
    assert mine.T @ mine == pytest.approx(np.eye(5), abs=1e-8)
    assert np.abs((mine * vectors[:, order]).sum(0)) == pytest.approx(np.ones(5), abs=1e-4)


def test_whole_and_low_rank_matrices(spark):
    m = sparse_symmetric(12, 0.5, 6)
    found = spectral.leading(as_entries(spark, m), 12)
    assert found.rounds == 1 and sorted(np.abs(found.values)) == pytest.approx(sorted(np.abs(np.linalg.eigvalsh(m))))
    x = np.random.default_rng(7).normal(size=(40, 2))
    low = spectral.leading(as_entries(spark, x @ x.T), 6)
    expected = np.linalg.eigvalsh(x @ x.T)
    assert list(low.values[:2]) == pytest.approx(list(expected[::-1][:2])) and np.abs(low.values[2:]).max(initial=0) < 1e-6
    assert spectral.leading(as_entries(spark, np.zeros((2, 2))), 3).vectors.count() == 0


def test_many_items(spark):
    """A hundred thousand items, on a cycle with heavy edges: no table of items by items, no list of items on the driver."""
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + 1) % n).alias("j"), F.when(F.col("id") % 1000 == 0, F.col("id") / 1000 + 100.0).otherwise(0.5).alias("value"))
    both = ring.unionByName(ring.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    found = spectral.leading(both, 2, oversampling=6, tolerance=1e-4, max_rounds=2)
    assert found.vectors.count() == n and len(found.values) == 2 and abs(found.values[0]) > 10


def test_vectors_rebuild_the_matrix(spark, season):
    table = stored(itemspace.pmi(itemspace.cooccurrence(season)))
    universe = itemspace.item_universe(season).unionByName(spark.createDataFrame([(7,)], "card int"))
    vectors, spectrum = itemspace.factorise(spark, table, universe, 200)
    rows = {r["card"]: np.array(r["vector"]) for r in vectors.collect()}
    signs = np.array([r["sign"] for r in spectrum.orderBy("k").collect()])
    assert len(signs) == len(rows) and not rows[7].any()
    for r in table.collect():
        assert (rows[r["card_i"]] * rows[r["card_j"]] * signs).sum() == pytest.approx(r["pmi"], abs=1e-8)


def test_conjugate_gradient(spark):
    x = np.random.default_rng(8).normal(size=(50, 6))
    m, right = x.T @ x, np.arange(6.0)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(right.tolist())], "i int, value double")
    found = {r["i"]: r["value"] for r in spectral.conjugate_gradient(as_entries(spark, m), frame, 0.5, 1e-10).collect()}
    assert [found[i] for i in range(6)] == pytest.approx(list(np.linalg.solve(m + 0.5 * np.eye(6), right)), abs=1e-6)


def test_matchup_is_antisymmetric(season):
    scored, model = matchup.matchup_scores(season)
    first = {(r["battle_time"], r["a_tag"]): r for r in scored.collect()}
    assert len(first) == season.count() and len(model.weights) == 4
    swapped = season.selectExpr(
        *[c for c in season.columns if c[:2] not in ("a_", "b_")], "1 - a_won AS a_won",
        *[f"{x}_{f} AS {y}_{f}" for x, y in ("ab", "ba") for f in SEASON_FIELDS],
    )
    for r in matchup.score(model, swapped).collect():
        mine = first[(r["battle_time"], r["b_tag"])]
        assert r["score"] + mine["score"] == pytest.approx(1.0)
        for block in matchup.BLOCKS:
            assert r[block] == pytest.approx(-mine[block], abs=1e-9)


def test_matchup_learns_a_cycle(spark):
    """Outcomes follow skill and a rock-paper-scissors of decks: held-out loss is below that of the parts without counters."""
    rng = np.random.default_rng(9)
    skill, rows = rng.normal(size=40), []
    for t in range(3000):
        a, b = (int(x) for x in rng.choice(40, 2, replace=False))
        kind = rng.integers(0, 3, 2)
        decks = [[int(k) * 10 + int(x) for x in rng.choice(8, 4, replace=False)] for k in kind]
        edge = 2.0 * ((kind[0] - kind[1] + 1) % 3 - 1) + skill[a] - skill[b]
        rows.append((t, f"p{a}", f"p{b}", *decks, [1] * 4, [1] * 4, int(rng.random() < 1 / (1 + np.exp(-edge)))))
    frame = spark.createDataFrame(rows, "battle_time int, a_tag string, b_tag string, a_cards array<int>, b_cards array<int>, a_levels array<int>, b_levels array<int>, a_won int")
    scored, model = matchup.matchup_scores(frame)
    held = scored.filter("part = 'test'")
    loss = lambda logit: held.agg(F.avg(F.log1p(F.exp(F.when(F.col("a_won") == 1, -logit).otherwise(logit))))).head()[0]
    linear = loss(F.col("skill") + F.col("investment") + F.col("deck"))
    whole = loss(F.col("skill") + F.col("investment") + F.col("deck") + F.col("counters"))
    assert whole < linear - 0.1 and linear < 0.6931 and model.weights[3] > 0.02


def test_earliest_share_stamps_the_rows_of_the_rank(spark):
    """Rows are not sorted or rewritten: only the ordering columns are, and the cut is that of the rank."""
    from contest_panel.operators import assign

    frame = spark.range(101).selectExpr("cast(pmod(id * 37, 101) AS int) DIV 3 AS t", "concat('p', id) AS a", "id AS payload")
    want = {(r["a"], r["part"]) for r in assign.time_split(frame, ["t", "a"], 0.3).collect()}
    assert {(r["a"], r["part"]) for r in assign.earliest_share(frame, ["t", "a"], 0.3).collect()} == want
    assert {r["part"] for r in assign.earliest_share(frame, ["t", "a"], 0.0).collect()} == {"test"}
    assert "Exchange rangepartitioning" not in assign.earliest_share(frame, ["t", "a"], 0.3)._jdf.queryExecution().toString()


def test_item_sums_leave_tasks_added_up(spark):
    """A task sends a row per pair of items, not one per pair and contest; repeated and NULL items and decks count as before."""
    rows = [([1, 2, 2, None], [2, 3], 1.0, 2.0), (None, [1], 1.0, 1.0), ([4], [5], -0.5, 1.0)] * 40
    frame = spark.createDataFrame(rows, "a_cards array<int>, b_cards array<int>, r double, w double").coalesce(1)
    entries, right = paired.item_equations(frame, "r", "w")
    got = {(r["i"], r["j"]): r["value"] for r in entries.collect()}
    assert got == {(1, 1): 80.0, (1, 3): -80.0, (3, 1): -80.0, (3, 3): 80.0, (4, 4): 40.0, (4, 5): -40.0, (5, 4): -40.0, (5, 5): 40.0}
    assert {r["i"]: r["value"] for r in right.collect()} == {1: 40.0, 3: -40.0, 4: -20.0, 5: 20.0}
    facing = paired.facing_counts(frame, "r", "w")
    assert "MapInArrow" in facing._jdf.queryExecution().toString()
    found = {(r["i"], r["j"]): (r["n"], round(r["r"], 9)) for r in facing.collect() if r["i"] < r["j"]}
    assert found == {(1, 2): (80.0, 0.5), (1, 3): (80.0, 0.5), (2, 3): (160.0, 0.5), (4, 5): (40.0, -0.5)}
