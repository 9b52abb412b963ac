"""Named dedup variants and table-maintenance joins.

``row_number() = 1`` lets Spark limit each group before the shuffle, so a key with very many copies
sends at most one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from contest_panel.operators.skew import BROADCAST_KEYS, DEFAULT_HOT_ROWS, join_on_key
from contest_panel.session import row_count_up_to

COLLECTION_ORDER = ("collected_at", "run_id")


def _edge_row(frame: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    # Ties are settled by content, so rows that still tie are equal and any of them will do. The content is the
    # columns at hand: select what is needed beforehand, and the scan still reads no more than that.
    spec = Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]))
    return frame.withColumn("__nth", F.row_number().over(spec)).filter("__nth = 1").drop("__nth")


def first_per_key(
    frame: DataFrame, keys: Sequence[str] = ("battle_key",), order: Sequence[str | Column] = COLLECTION_ORDER
) -> DataFrame:
    """First row per key in an explicit order (the reader's file order is not one)."""
    return _edge_row(frame, keys, order)


def last_per_key(
    frame: DataFrame, keys: Sequence[str] = ("battle_key",), order: Sequence[str] = COLLECTION_ORDER
) -> DataFrame:
    """Last row per key: later rows overwrite."""
    return _edge_row(frame, keys, [F.col(c).desc() for c in order])


def clean_first(parsed: DataFrame) -> DataFrame:
    """First clean, labelled row per key: dirty rows do not claim the key."""
    return first_per_key(parsed.filter("is_clean_1v1 AND label_a_win IS NOT NULL"))


def dedup_then_clean(parsed: DataFrame, clean_only: bool = False) -> DataFrame:
    """First row per key, filtered afterwards: a dirty first row hides later clean ones."""
    kept = first_per_key(parsed)
    return kept.filter("is_clean_1v1") if clean_only else kept


def new_rows(batch: DataFrame, stored: DataFrame, keys: Sequence[str] = ("battle_key",)) -> DataFrame:
    """Rows of ``batch`` whose key was never stored, once each.

    The batch is reduced to one row per key first, so the anti-join sees no repeated keys.
    """
    keys = list(keys)
    return first_per_key(batch, keys).join(stored.select(*keys), keys, "left_anti")


def eligible_entities(clean: DataFrame, minimum: int = 11) -> DataFrame:
    """Participants of at least ``minimum`` clean contests: (tag, battles)."""
    tags = clean.select(F.explode(F.array("a_tag", "b_tag")).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("battles")).filter(F.col("battles") >= minimum)


def rows_of_eligible(focal: DataFrame, eligible: DataFrame, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Focal rows of eligible participants; those with very many rows stay spread over tasks.

    The battle counts of ``eligible`` already tell who they are. Runs an action.
    """
    keys = eligible.select(F.col("tag").alias("player_tag"), "battles")
    hot = keys.filter(F.col("battles") > hot_rows).select("player_tag")
    found = row_count_up_to(hot, BROADCAST_KEYS)
    known = None if not found else F.broadcast(hot) if found <= BROADCAST_KEYS else hot
    return join_on_key(focal, keys.select("player_tag"), "player_tag", "left_semi", known, "battle_key")


def merge_new_members(existing: DataFrame, incoming: DataFrame, key: str = "tag") -> DataFrame:
    """Append members not present yet (first incoming row per key)."""
    fresh = first_per_key(incoming, [key], [c for c in incoming.columns if c != key])
    fresh = fresh.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def upsert_poll_state(cohort: DataFrame, polls: DataFrame) -> DataFrame:
    """Apply one pass of polling results to the cohort counters.

    ``polls``: rows of polled members with ``polled_at`` (NULL when the fetch failed) and ``kept``; several
    polls of a member are combined first, so a member stays one row.
    """
    update = polls.groupBy("tag").agg(
        F.max("polled_at").alias("polled_at"),
        F.count("polled_at").alias("__ok"),
        F.sum(F.when(F.col("polled_at").isNotNull(), F.col("kept"))).alias("__kept"),
        F.count_if(F.col("polled_at").isNull()).alias("__fail"),
    )
    return cohort.join(update, "tag", "left").select(
        *[c for c in cohort.columns if c not in ("last_polled", "n_polls", "n_battles", "n_fail")],
        F.coalesce("polled_at", "last_polled").alias("last_polled"),
        (F.col("n_polls") + F.coalesce("__ok", F.lit(0))).alias("n_polls"),
        (F.col("n_battles") + F.coalesce("__kept", F.lit(0))).alias("n_battles"),
        (F.col("n_fail") + F.coalesce("__fail", F.lit(0))).alias("n_fail"),
    )
