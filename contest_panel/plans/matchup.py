"""Matchup model: who wins, as a sum of four antisymmetric log-odds fitted one after another.

    log odds(A beats B) = c1 skill + c2 investment + c3 deck + c4 counters

Skill is a rating per participant, investment an odd monotone function of the level difference, deck the difference of additive
item strengths, counters the antisymmetric product of low-rank deck factors. Every part is fitted to what the parts before it
leave over, on the earlier contests of the training share; the four weights are fitted on its last contests, which the
parts have not seen, so a part that only fits noise gets a weight near zero. There is no intercept: p(A, B) + p(B, A) = 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from contest_panel.functions.decks import deck_total
from contest_panel.operators import assign, paired
from contest_panel.operators.skew import BROADCAST_KEYS, hot_keys, join_on_key
from contest_panel.session import row_count_up_to, stored

BLOCKS = ("skill", "investment", "deck", "counters")
RANK = 8


@dataclass(frozen=True)
class Matchup:
    """Fitted parts. ``ratings``: (player, rating); ``curve``: (size, log_odds) for every size up to the largest;
    ``items``: (item, strength, blade, chest); ``weights``: one per block; ``history`` of the iterations."""

    ratings: DataFrame
    curve: DataFrame
    items: DataFrame
    weights: tuple[float, ...]
    history: dict = field(default_factory=dict)


def _attach(rows: DataFrame, table: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join with a table of one row per key: broadcast if it counts few rows, else by a join that spreads hot keys."""
    if row_count_up_to(table, BROADCAST_KEYS) <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table), key, "left")
    return join_on_key(rows, table, key, "left", hot_keys(rows, key), spread_by)


def with_skill(battles: DataFrame, ratings: DataFrame) -> DataFrame:
    """``skill``: rating of side A minus that of side B; participants without a rating have 0."""
    one, other = (ratings.select(F.col("player").alias(f"{s}_tag"), F.col("rating").alias(f"__{s}")) for s in "ab")
    met = _attach(_attach(battles, one, "a_tag", "b_tag"), other, "b_tag", "a_tag")
    return met.withColumn("skill", F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))).drop("__a", "__b")


def _gap() -> Column:
    return F.expr(f"{deck_total('a_levels')} - {deck_total('b_levels')}")


def investment_curve(battles: DataFrame) -> DataFrame:
    """The odd monotone curve of outcome by level difference, from counts by difference."""
    counts = battles.select(_gap().alias("advantage"), "a_won").groupBy("advantage").agg(F.count(F.lit(1)).alias("battles"), F.sum("a_won").alias("wins"))
    return paired.odd_isotonic(paired.mirrored_counts(counts))


def _every_size(curve: DataFrame) -> DataFrame:
    """The curve at every whole size up to the largest known one; sizes in between take the block below them."""
    top = curve.agg(F.coalesce(F.max("size"), F.lit(0)).cast("long")).head()[0]
    sizes = curve.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("size"))
    known = sizes.join(curve.select(F.col("size").cast("int").alias("size"), "log_odds"), "size", "left")
    upto = F.last("log_odds", ignorenulls=True).over(Window.orderBy("size"))  # one row per size of a level difference
    return known.select("size", F.coalesce(upto, F.lit(0.0)).alias("log_odds"))


def with_investment(battles: DataFrame, curve: DataFrame) -> DataFrame:
    """``investment``: the curve at the level difference; beyond the largest known size it stays level."""
    top = curve.agg(F.max("size")).head()[0]
    sized = battles.withColumn("__gap", _gap()).withColumn("size", F.least(F.abs("__gap"), F.lit(top)).cast("int"))
    found = sized.join(F.broadcast(curve), "size", "left")
    return found.withColumn("investment", F.coalesce(F.signum("__gap") * F.col("log_odds"), F.lit(0.0))).drop("__gap", "size", "log_odds")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def deck_table(battles: DataFrame, items: DataFrame, rank: int = RANK) -> DataFrame:
    """Sums over the items of every distinct deck: (deck, strength, blade, chest). Items the model doesn't know add nothing."""
    decks = battles.select(F.explode(F.array(F.sort_array("a_cards"), F.sort_array("b_cards"))).alias("deck")).distinct()
    held = decks.select("deck", F.explode("deck").alias("item")).join(items, "item", "left")
    sums = lambda name: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(d))), F.lit(0.0)) for d in range(rank)]).alias(name)
    return held.groupBy("deck").agg(F.coalesce(F.sum("strength"), F.lit(0.0)).alias("strength"), sums("blade"), sums("chest"))


def with_decks(battles: DataFrame, items: DataFrame, rank: int = RANK) -> DataFrame:
    """``deck`` (difference of strengths) and ``counters`` (blade of A times chest of B, minus the reverse). Runs an action."""
    table = stored(deck_table(battles, items, rank))
    met = battles.withColumns({f"__deck_{s}": F.sort_array(f"{s}_cards") for s in "ab"})
    for side, spread_by in (("a", "b_tag"), ("b", "a_tag")):
        own = table.select(F.col("deck").alias(f"__deck_{side}"), *[F.col(c).alias(f"__{c}_{side}") for c in ("strength", "blade", "chest")])
        met = _attach(met, own, f"__deck_{side}", spread_by)
    found = met.withColumn("deck", F.coalesce(F.col("__strength_a") - F.col("__strength_b"), F.lit(0.0))).withColumn(
        "counters", F.coalesce(_dot("__blade_a", "__chest_b") - _dot("__chest_a", "__blade_b"), F.lit(0.0))
    )
    return found.drop(*[f"__{c}_{s}" for c in ("deck", "strength", "blade", "chest") for s in "ab"])


def _logit(blocks: Sequence[str], weights: Sequence[float]) -> Column:
    return sum((F.lit(float(w)) * F.col(b) for b, w in zip(blocks, weights)), F.lit(0.0))


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def block_weights(rows: DataFrame, blocks: Sequence[str], label: str = "a_won", ridge: float = 1.0, max_rounds: int = 25, tolerance: float = 1e-8) -> tuple[float, ...]:
    """Logistic regression on a few columns without intercept, by Newton steps; each is one aggregation of the rows (an action)."""
    k, weights = len(blocks), np.zeros(len(blocks))
    for _ in range(max_rounds):
        p = _chance(_logit(blocks, weights))
        slope = [F.sum((F.col(label) - p) * F.col(b)) for b in blocks]
        bend = [F.sum(p * (1 - p) * F.col(a) * F.col(b)) for i, a in enumerate(blocks) for b in blocks[i:]]
        found = np.array([x or 0.0 for x in rows.agg(*[c.alias(f"s{i}") for i, c in enumerate([*slope, *bend])]).head()])
        curvature = np.zeros((k, k))
        curvature[np.triu_indices(k)] = found[k:]
        curvature += np.triu(curvature, 1).T + ridge * np.eye(k)
        step = np.linalg.solve(curvature, found[:k] - ridge * weights)
        weights = weights + step
        if np.abs(step).max() <= tolerance:
            break
    return tuple(float(w) for w in weights)


def fit(battles: DataFrame, order: Sequence[str] = ("battle_time", "a_tag", "b_tag"), tune_share: float = 0.2, rank: int = RANK, ridge: float = 20.0) -> Matchup:
    """Fit all parts on ``battles`` (their order decides which are the last ones). Runs actions."""
    split = assign.earliest_share(battles.select(*order, *[c for c in ("a_cards", "b_cards", "a_levels", "b_levels", "a_won") if c not in order]), list(order), 1 - tune_share)
    early = split.filter("part = 'train'")
    rated = paired.skill_ratings(paired.pair_counts(early), tolerance=1e-3)
    ratings = rated.table.select("player", "rating")
    curve = stored(_every_size(investment_curve(early)))
    rows = stored(with_investment(with_skill(split, ratings), curve))
    late, early = rows.filter("part <> 'train'"), rows.filter("part = 'train'")

    def left_over(blocks: Sequence[str], known: DataFrame, at: DataFrame) -> DataFrame:
        p = _chance(_logit(blocks, block_weights(known, blocks)))
        return at.withColumn("__r", F.col("a_won") - p).withColumn("__w", p * (1 - p))

    strengths = stored(paired.item_strengths(left_over(BLOCKS[:2], late, early), "__r", "__w", ridge))
    nothing = F.array_repeat(F.lit(0.0), rank)
    rows = stored(with_decks(rows, strengths.withColumn("blade", nothing).withColumn("chest", nothing), rank))
    late, early = rows.filter("part <> 'train'"), rows.filter("part = 'train'")
    factors = paired.counter_factors(paired.facing_counts(left_over(BLOCKS[:3], late, early), "__r", "__w"), rank, ridge, max_rounds=8, tolerance=1e-2)
    items = stored(strengths.join(factors.table, "item", "full"))
    scored = stored(with_decks(late.drop("deck", "counters"), items, rank).select("a_won", *BLOCKS))
    return Matchup(ratings, curve, items, block_weights(scored, BLOCKS), {"skill": rated.history, "counters": factors.history})


def score(model: Matchup, battles: DataFrame, rank: int = RANK) -> DataFrame:
    """``battles`` with ``score`` (probability that side A wins) and the log-odds of each block. Runs an action."""
    found = with_decks(with_investment(with_skill(battles, model.ratings), model.curve), model.items, rank)
    weighed = found.withColumns({b: F.col(b) * F.lit(w) for b, w in zip(BLOCKS, model.weights)})
    return weighed.withColumn("score", _chance(_logit(BLOCKS, [1.0] * len(BLOCKS))))


def matchup_scores(battles: DataFrame, train_share: float = 0.75) -> tuple[DataFrame, Matchup]:
    """Fit on the earliest share, score everything: battles with ``part``, ``score`` and one log-odds per block. Runs actions.

    All columns of ``battles`` are stored once; hand over the ones that are wanted.
    """
    ranked = assign.earliest_share(stored(battles), ["battle_time", "a_tag", "b_tag"], train_share)
    model = fit(ranked.filter("part = 'train'").drop("part"))
    return score(model, ranked), model
