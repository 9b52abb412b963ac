"""Paired comparisons: skill per participant, an odd monotone effect, additive item strengths, antisymmetric item factors.

Each part is fitted from sufficient statistics that one pass over the contests gives (counts per pair of participants, per
advantage, per pair of items); the iterations run over those tables only. A log-odds that any part adds changes its sign
when the sides are swapped. Nothing here limits the number of participants or items: coefficients stay in tables, and
only totals of a round reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from contest_panel.operators import spectral
from contest_panel.operators.skew import BROADCAST_KEYS, hot_keys, join_on_key
from contest_panel.session import parallelism, row_count_up_to, ship, stored

# --- skill: minorise and maximise ----------------------------------------------------------------


@dataclass(frozen=True)
class Ratings:
    """``table``: (player, rating, games); ``history``: (round, log likelihood, largest change), one tuple per round."""

    table: DataFrame
    history: list[tuple[int, float, float]]


def pair_counts(contests: DataFrame, a: str = "a_tag", b: str = "b_tag", won: str = "a_won") -> DataFrame:
    """Games and wins of every participant against every other: (player, other, n, wins), counted map-side.

    Both directions of a pair are rows. Contests against oneself or without both names or a result say nothing and are left out.
    """
    sides = F.expr(f"inline(array(named_struct('player', {a}, 'other', {b}, 'won', cast({won} AS long)), named_struct('player', {b}, 'other', {a}, 'won', 1L - {won})))")
    known = contests.filter((F.col(a) != F.col(b)) & F.col(won).isNotNull())
    return known.select(sides).groupBy("player", "other").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"))


def skill_ratings(pairs: DataFrame, prior: float = 1.0, tolerance: float = 1e-5, max_rounds: int = 200) -> Ratings:
    """Log strengths of the Bradley-Terry model by minorise-maximise rounds. Runs actions, two per round.

    ``prior`` wins and as many losses against an opponent of rating 0 keep ratings finite and fix their origin. Every round raises the
    penalised log likelihood; they end when no rating moves by more than ``tolerance``. After every second round the two
    steps are extrapolated (squared polynomial extrapolation), which is taken back if it would lower the likelihood. A round
    joins the pair table with the ratings of both sides and sums per player, map-side first. A player with very many
    opponents is a hot key of these joins and is salted there. Pairs are stored by player, so the sums of a round are nearly
    complete before their shuffle; a player has at most one row per other one.
    """
    pairs = stored(pairs.repartition(parallelism(pairs.sparkSession), "player").sortWithinPartitions("player"))
    start = stored(pairs.select("player").distinct().withColumn("rating", F.lit(0.0)))
    few = row_count_up_to(start, BROADCAST_KEYS) <= BROADCAST_KEYS
    hot = None if few else hot_keys(pairs, "player")
    hot_other = None if hot is None else hot.withColumnRenamed("player", "other")

    def moved(state: DataFrame) -> tuple[DataFrame, float, float]:
        """``state`` (player, rating and other columns) with the next rating, the fit of the present one, and the largest change."""
        mine = state.withColumnRenamed("rating", "own")
        theirs = state.select(F.col("player").alias("other"), F.col("rating").alias("their"))
        if few:
            met = pairs.join(F.broadcast(theirs), "other").join(F.broadcast(mine), "player")
        else:
            met = join_on_key(join_on_key(pairs, theirs, "other", "inner", hot_other, "player"), mine, "player", "inner", hot, "other")
        both = F.exp("own") + F.exp("their")
        rest = [c for c in state.columns if c not in ("player", "rating")]
        sums = met.groupBy("player").agg(
            F.sum("n").alias("games"), F.sum("wins").alias("wins"), F.sum(F.col("n") / both).alias("weight"),
            F.sum(F.col("wins") * (F.col("own") - F.log(both))).alias("fit"), F.first("own").alias("rating"), *[F.first(c).alias(c) for c in rest],
        )
        gamma = F.exp("rating")
        fresh = F.log((F.col("wins") + prior) / (F.col("weight") + 2 * prior / (gamma + 1)))
        at_prior = prior * (F.col("rating") - 2 * F.log(gamma + 1))
        found = stored(sums.select("player", "games", "rating", fresh.alias("next"), (F.col("fit") + at_prior).alias("fit"), *rest))
        fit, change = found.agg(F.coalesce(F.sum("fit"), F.lit(0.0)), F.coalesce(F.max(F.abs(F.col("next") - F.col("rating"))), F.lit(0.0))).head()
        return found, fit, change

    history: list[tuple[int, float, float]] = []
    state, plain, rounds = start, None, 0
    while True:
        first, fit, change = moved(state)
        rounds += 1
        if plain is not None and fit < history[-1][1]:  # the extrapolation went too far
            state, plain = plain, None
            continue
        history.append((rounds, fit, change))
        if change <= tolerance or rounds >= max_rounds:
            break
        second, fit, change = moved(first.select("player", F.col("next").alias("rating"), F.col("rating").alias("origin")))
        rounds += 1
        history.append((rounds, fit, change))
        first = second
        if change <= tolerance or rounds >= max_rounds:
            break
        step, bend = F.col("rating") - F.col("origin"), F.col("next") - 2 * F.col("rating") + F.col("origin")
        r, v = second.agg(F.sum(step * step), F.sum(bend * bend)).head()
        a = min(100.0, max(1.0, (r / v) ** 0.5 if v else 1.0))
        state = second.select("player", (F.col("origin") + 2 * a * step + a * a * bend).alias("rating"))
        plain = second.select("player", F.col("next").alias("rating"))
    return Ratings(first.select("player", F.col("next").alias("rating"), "games"), history)


# --- an odd monotone effect: pool adjacent violators ---------------------------------------------


def mirrored_counts(counts: DataFrame, x: str = "advantage", n: str = "battles", wins: str = "wins", within: Sequence[str] = ()) -> DataFrame:
    """Counts by size of the advantage, seen from the side that holds it: (…, size, n, wins). A tie of advantages counts half a win."""
    won = F.when(F.col(x) > 0, F.col(wins)).when(F.col(x) < 0, F.col(n) - F.col(wins)).otherwise(F.col(n) / 2)
    return counts.filter(F.col(x).isNotNull()).groupBy(*within, F.abs(x).alias("size")).agg(F.sum(n).alias("n"), F.sum(won.cast("double")).alias("wins"))


def odd_isotonic(counts: DataFrame, within: Sequence[str] = (), prior: float = 0.5) -> DataFrame:
    """Odd, non-decreasing log-odds of winning by size of the advantage: (…, size, n, wins, block, block_rate, log_odds).

    ``counts`` is :func:`mirrored_counts`. ``prior`` wins and losses at every size keep log-odds finite. Neighbours whose rates fall
    are pooled, a whole falling run at once, until none fall: the only non-decreasing fit of least squares and of largest
    likelihood. Rates below one half are one half, and size 0 is, so that the function is odd. ``block`` is the smallest size of a
    block. The windows hold one row per size of a group. Runs an action per round.
    """
    prior_n = 2 * prior
    base = stored(
        counts.select(*within, "size", "n", "wins", F.col("size").alias("block"), (F.col("n") + prior_n).alias("__n"), (F.col("wins") + prior).alias("__w"))
    )
    blocks = base.filter("size > 0").select(*within, "block", F.col("__n"), F.col("__w"))
    ordered = Window.partitionBy(*within).orderBy("block")
    while True:
        falls = F.col("__w") / F.col("__n") <= F.lag(F.col("__w") / F.col("__n")).over(ordered)
        marked = stored(blocks.withColumn("__new", F.coalesce(~falls, F.lit(True))))
        if marked.filter(~F.col("__new")).isEmpty():
            break
        head = F.max(F.when(F.col("__new"), F.col("block"))).over(ordered)
        blocks = marked.withColumn("__head", head).groupBy(*within, F.col("__head").alias("block")).agg(F.sum("__n").alias("__n"), F.sum("__w").alias("__w"))
    found = marked.select(*within, "block", F.greatest(F.lit(0.5), F.col("__w") / F.col("__n")).alias("block_rate"), F.lit(True).alias("__head"))
    # Every size takes the last block that starts at or before it.
    both = base.select(*within, "size", "n", "wins").join(found.withColumnRenamed("block", "size"), [*within, "size"], "left")
    upto = Window.partitionBy(*within).orderBy("size")
    rate = F.coalesce(F.last("block_rate", ignorenulls=True).over(upto), F.lit(0.5))
    start = F.coalesce(F.last(F.when(F.col("__head"), F.col("size")), ignorenulls=True).over(upto), F.lit(0))
    filled = both.select(*within, "size", "n", "wins", start.alias("block"), rate.alias("block_rate"))
    return filled.withColumn("log_odds", F.log(F.col("block_rate") / (1 - F.col("block_rate"))))


# --- items: additive strengths -------------------------------------------------------------------

#: Products of item pairs that a task holds at once.
PRODUCTS = 1 << 20


def _decks(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Items of a batch in their order, and for the rows with both decks (columns 0 and 1) the places of their items there,
    -1 for none or NULL, and the numbers of these rows."""
    rows = np.flatnonzero(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()).to_numpy(zero_copy_only=False))
    decks = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
    held = pa.concat_arrays([d.flatten() for d in decks]).dictionary_encode()
    order = pc.sort_indices(held.dictionary).to_numpy()
    place = np.append(np.argsort(order), -1)
    code = place[held.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    sides, start = [], 0
    for deck in decks:
        size = deck.value_lengths().to_numpy(zero_copy_only=False)
        slots = np.arange(size.max(initial=0)) < size[:, None]
        side = np.full(slots.shape, -1)
        side[slots] = code[start : start + size.sum()]
        start += size.sum()
        sides.append(side)
    return held.dictionary.take(pa.array(order)), *sides, rows


def _pair_sums(rows: DataFrame, values: Sequence[str], names: Sequence[str], work: Callable) -> DataFrame:
    """Sums over the contests for pairs of items, (one, other, and ``names``): tasks add up batches with arrays, a shuffle the batches.

    ``work`` takes places of the items in both decks and the ``values`` of a slice of contests, and gives the places of both ends and
    the values to be summed, one array of pairs for each name.
    """
    ship(rows.sparkSession)
    kind = rows.schema["a_cards"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            items, a, b, at = _decks(batch)
            known = [batch.column(2 + i).fill_null(0.0).to_numpy(zero_copy_only=False)[at] for i in range(len(values))]
            slice_rows = max(1, PRODUCTS // max(1, (a.shape[1] + b.shape[1]) ** 2))
            for first in range(0, len(at), slice_rows):
                here = slice(first, first + slice_rows)
                one, other, sums = work(a[here], b[here], *[v[here] for v in known])
                code = one * len(items) + other
                if len(items) ** 2 <= max(4 * len(code), 1 << 16):
                    found = np.flatnonzero(np.bincount(code, minlength=len(items) ** 2))
                    added = [np.bincount(code, weights=v, minlength=len(items) ** 2)[found] for v in sums]
                else:
                    found, place = np.unique(code, return_inverse=True)
                    added = [np.bincount(place, weights=v) for v in sums]
                ends = [items.take(pa.array(e)) for e in (found // max(1, len(items)), found % max(1, len(items)))]
                yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, added)], ["one", "other", *names])

    held = rows.select("a_cards", "b_cards", *[F.col(v).cast("double") for v in values])
    schema = f"one {kind}, other {kind}, " + ", ".join(f"{n} double" for n in names)
    return held.mapInArrow(run, schema).groupBy("one", "other").agg(*[F.sum(n).alias(n) for n in names])


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each item of ``x`` is in the same row of ``y``."""
    return (x[:, :, None] == y[:, None, :]).any(axis=2)


def item_equations(rows: DataFrame, residual: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """Normal equations of additive item strengths (+1 for an item only side A holds, -1 for one only side B does).

    Returns (i, j, value) and (i, value): sums over the contests of weight · x_i · x_j and of residual · x_i, combined in tasks.
    NULL items and contests without both decks are left out.
    """

    def products(a: np.ndarray, b: np.ndarray, r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        x = np.hstack([a, b])
        again = ((x[:, :, None] == x[:, None, :]) & np.tri(x.shape[1], k=-1, dtype=bool)).any(axis=2)
        only = np.hstack([~_within(a, b), ~_within(b, a)]) & (x >= 0) & ~again
        sign = np.where(only, np.r_[np.ones(a.shape[1]), -np.ones(b.shape[1])], 0.0)
        met = only[:, :, None] & only[:, None, :]
        own = np.eye(x.shape[1], dtype=bool)  # the sum of residuals goes with the pair of an item and itself
        one, other = np.broadcast_to(x[:, :, None], met.shape)[met], np.broadcast_to(x[:, None, :], met.shape)[met]
        value = sign[:, :, None] * sign[:, None, :] * w[:, None, None]
        return one, other, [value[met], (own * (sign * r[:, None])[:, :, None])[met]]

    sums = stored(_pair_sums(rows, [residual, weight], ["value", "right"], products))
    entries = sums.select(F.col("one").alias("i"), F.col("other").alias("j"), "value")
    return entries, sums.filter("one = other").select(F.col("one").alias("i"), F.col("right").alias("value"))


def item_strengths(rows: DataFrame, residual: str, weight: str, ridge: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    """(item, strength): one Newton step of the penalised likelihood from the log-odds behind ``residual``. Runs actions.

    Strengths are log-odds to be added to those. The sparse equations are solved by conjugate gradients over tables.
    """
    entries, right = item_equations(rows, residual, weight)
    return spectral.conjugate_gradient(entries, right, ridge, tolerance).select(F.col("i").alias("item"), F.col("value").alias("strength"))


# --- items: antisymmetric factors by alternating least squares -----------------------------------


def facing_counts(rows: DataFrame, residual: str, weight: str) -> DataFrame:
    """What the log-odds leave over for every two items that face each other: (i, j, n, r), both directions, r(i, j) = -r(j, i).

    ``n`` sums the weights of the contests, ``r`` is the sum of residuals over ``n``. Pairs that meet in both directions within a
    contest cancel and are left out.
    """

    def met(a: np.ndarray, b: np.ndarray, r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        both = _within(a, b)[:, :, None] & _within(b, a)[:, None, :]
        pairs = (a >= 0)[:, :, None] & (b >= 0)[:, None, :] & (a[:, :, None] != b[:, None, :]) & ~both
        row, x, y = np.nonzero(pairs)
        i, j = a[row, x], b[row, y]
        return np.minimum(i, j), np.maximum(i, j), [w[row], np.where(i < j, r[row], -r[row])]

    summed = _pair_sums(rows, [residual, weight], ["n", "r"], met).filter("n > 0")
    both = "inline(array(named_struct('i', one, 'j', other, 'n', n, 'r', r / n), named_struct('i', other, 'j', one, 'n', n, 'r', -r / n)))"
    return summed.select(F.expr(both))


def _twist(vectors: np.ndarray) -> np.ndarray:
    """(u, v) to (v, -u): the product of (u_i, v_i) with the twisted (u_j, v_j) is u_i v_j - v_i u_j, which is antisymmetric."""
    half = vectors.shape[1] // 2
    return np.hstack([vectors[:, half:], -vectors[:, :half]])


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _solve_items(met: DataFrame, width: int, ridge: float) -> DataFrame:
    """Each item's least-squares vector given the others': (i, vector). ``met``: i, other (the others' vectors), n, r.

    Tasks sum the normal equations of the items they meet, batch by batch; these sums are shuffled by item, added and solved.
    """
    ship(met.sparkSession)
    kind = met.schema["i"].dataType.simpleString()

    def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        return keys[order][first], np.add.reduceat(values[order], first, axis=0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            other, n, r = _twist(_rows(batch.column(1))), *(batch.column(i).to_numpy() for i in (2, 3))
            weighed = other * n[:, None]
            equations = np.hstack([(weighed[:, :, None] * other[:, None, :]).reshape(len(n), -1), weighed * r[:, None]])
            at, total = sums(names.indices.to_numpy(), equations)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(at)), _lists(total)], ["i", "equations"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Array, np.ndarray] | None = None

        def solved(keys: pa.Array, total: np.ndarray) -> pa.RecordBatch:
            left = total[:, : width * width].reshape(-1, width, width) + ridge * np.eye(width)
            return pa.RecordBatch.from_arrays([keys, _lists(np.linalg.solve(left, total[:, width * width :, None])[:, :, 0])], ["i", "vector"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column(0), _rows(batch.column(1))
            if held:
                keys, values = pa.concat_arrays([held[0], keys]), np.vstack([held[1], values])
            names = keys.dictionary_encode()  # rows are sorted, so the last item may go on in the next batch
            at, total = sums(names.indices.to_numpy(), values)
            held = names.dictionary.slice(len(at) - 1), total[-1:]
            if len(at) > 1:
                yield solved(names.dictionary.slice(0, len(at) - 1), total[:-1])
        if held:
            yield solved(*held)

    added = met.select("i", "other", "n", "r").mapInArrow(partial, f"i {kind}, equations array<double>")
    return added.repartition("i").sortWithinPartitions("i").mapInArrow(solve, f"i {kind}, vector array<double>")


@dataclass(frozen=True)
class Factors:
    """``table``: (item, blade, chest); ``history``: the penalised squared error before every round and at the end."""

    table: DataFrame
    history: list[float]


def counter_factors(facing: DataFrame, rank: int = 8, ridge: float = 1.0, max_rounds: int = 20, tolerance: float = 1e-4, seed: int = 0) -> Factors:
    """Antisymmetric low-rank factors of facing items: r(i, j) ≈ blade_i · chest_j - chest_i · blade_j. Runs actions, three a round.

    Minimises the sum over pairs of n (r - prediction)^2 / 2 plus ``ridge`` times all squared factors. In a round all items solve
    their own normal equations against the others as they are; then the exact minimum on the way there is taken (the error
    is a polynomial of degree four in the step), so the error never rises. Rounds end when it falls by less than
    ``tolerance`` of itself.
    """
    facing = stored(facing)
    width = 2 * rank
    start = spectral.seeded_block(facing.select("i").distinct(), width, seed)
    current = stored(start.withColumn("vector", F.transform("vector", lambda x: x * 0.1)))
    history: list[float] = []
    while True:
        other = facing.join(current.select(F.col("i").alias("j"), F.col("vector").alias("other")), "j")
        if len(history) == max_rounds:
            wanted = current.withColumnRenamed("vector", "wanted")
        else:
            wanted = stored(_solve_items(other, width, ridge)).withColumnRenamed("vector", "wanted")
        both = stored(current.join(wanted, "i").select("i", "vector", F.zip_with("wanted", "vector", lambda w, v: w - v).alias("step")))
        values = _error_polynomial(facing, both) + ridge * _norm_polynomial(both)
        history.append(float(values[0]))
        if len(history) > max_rounds or values[0] == 0:
            break
        turning = np.roots(np.polyder(values[::-1]))
        tried = [0.0, 1.0, *(t.real for t in turning if abs(t.imag) < 1e-9 and 0 < t.real < 2)]
        step = min(tried, key=lambda t: np.polyval(values[::-1], t))
        reached = float(np.polyval(values[::-1], step))
        current = stored(both.select("i", F.zip_with("vector", F.transform("step", lambda s: s * step), lambda v, s: v + s).alias("vector")))
        if values[0] - reached <= tolerance * values[0]:
            history.append(reached)
            break
    half = lambda first: F.slice("vector", first, rank)
    return Factors(current.select(F.col("i").alias("item"), half(1).alias("blade"), half(rank + 1).alias("chest")), history)


def _error_polynomial(facing: DataFrame, moves: DataFrame) -> np.ndarray:
    """Coefficients, by power of the step, of half the weighted squared error over all pairs, each counted once (an action)."""
    half = facing.filter("i < j")
    ends = half.join(moves.select("i", F.col("vector").alias("a"), F.col("step").alias("da")), "i").join(
        moves.select(F.col("i").alias("j"), F.col("vector").alias("b"), F.col("step").alias("db")), "j"
    )
    ship(facing.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5)
        for batch in batches:
            if batch.num_rows:
                n, r = (batch.column(i).to_numpy() for i in (0, 1))
                a, da, b, db = (_rows(batch.column(i)) for i in range(2, 6))
                b, db = _twist(b), _twist(db)
                c = [(a * b).sum(1) - r, (a * db).sum(1) + (da * b).sum(1), (da * db).sum(1)]
                total += [(n * t).sum() for t in (c[0] ** 2, 2 * c[0] * c[1], c[1] ** 2 + 2 * c[0] * c[2], 2 * c[1] * c[2], c[2] ** 2)]
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    found = ends.select("n", "r", "a", "da", "b", "db").mapInArrow(run, "total array<double>").collect()
    return np.sum([r["total"] for r in found], axis=0) / 2 if found else np.zeros(5)


def _norm_polynomial(moves: DataFrame) -> np.ndarray:
    """Coefficients of half the sum of squares of all vectors (an action)."""
    dot = lambda x, y: F.sum(F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p))
    found = moves.agg(dot("vector", "vector"), dot("vector", "step"), dot("step", "step")).head()
    return np.array([found[0] or 0.0, 2 * (found[1] or 0.0), found[2] or 0.0, 0.0, 0.0]) / 2
