"""Per-item lookups inside arrays (vocabulary index, rarity offset)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from contest_panel.functions.decks import RARITY_OFFSETS
from contest_panel.operators.ranking import global_rank
from contest_panel.session import materialise, row_count_up_to

MAP_LIMIT = 4_096


def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def require_unique(dimension: DataFrame, key: str) -> None:
    """Raise when a key of the dimension occurs twice. Runs an action."""
    repeated = dimension.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"dimension key {key} is repeated: {[r[0] for r in repeated]}")


def map_items(
    frame: DataFrame,
    items: str,
    dimension: DataFrame,
    value: str,
    name: str,
    default: int | None = None,
    key: str = "id",
    row_key: Sequence[str] = (),
    limit: int = MAP_LIMIT,
) -> DataFrame:
    """Add ``name``: ``value`` of every item of the array ``items``, in place. Runs an action.

    A dimension of at most ``limit`` rows becomes a constant map, so no row is exploded or shuffled.
    A larger one is joined item by item and the arrays are rebuilt per ``row_key``; without one, rows are
    numbered and stored first. Both give the same: a NULL array stays NULL, an empty one empty, items the
    dimension lacks (or NULL ones) give ``default``, a repeated key of the dimension is an error.
    """
    known = dimension.select(key, value).filter(F.col(key).isNotNull())
    entries = known.limit(limit + 1).collect()
    if len(entries) <= limit:
        if len({e[0] for e in entries}) < len(entries):
            require_unique(known, key)
        if not entries:
            return frame.withColumn(name, F.expr(f"transform({items}, x -> {_sql(default)})"))
        keys = ", ".join(_sql(e[0]) for e in entries)
        values = ", ".join(_sql(e[1]) for e in entries)
        lookup = f"map_from_arrays(array({keys}), array({values}))"
        return frame.withColumn(
            name, F.expr(f"transform({items}, x -> coalesce(try_element_at({lookup}, x), {_sql(default)}))")
        )
    require_unique(known, key)
    added = not row_key
    if added:
        frame = materialise(frame.withColumn("__row", F.monotonically_increasing_id()))
        row_key = ["__row"]
    named = known.select(F.col(key).alias("__item"), F.col(value).alias("__value"))
    looked_up = (
        frame.select(*row_key, F.posexplode(items).alias("__at", "__item"))
        .join(named, "__item", "left")
        .groupBy(*row_key)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("__at", F.coalesce("__value", F.lit(default)).alias("v")))
            ).alias("__pairs")
        )
        .select(*row_key, F.col("__pairs.v").alias("__found"))
    )
    rebuilt = F.coalesce("__found", F.when(F.col(items).isNotNull(), F.expr("array()")))
    joined = frame.join(looked_up, list(row_key), "left").withColumn(name, rebuilt).drop("__found")
    return joined.drop("__row") if added else joined


def vocabulary(dimension: DataFrame, key: str = "id") -> DataFrame:
    """Dense index 1..n of the sorted ids; 0 stays free for unseen ones."""
    ids = dimension.select(key).distinct()
    if row_count_up_to(ids, MAP_LIMIT) <= MAP_LIMIT:
        # Counted: small enough to number in one task.
        return ids.withColumn("idx", F.row_number().over(Window.orderBy(key)))
    return global_rank(ids, [key], "idx")


def encode(frame: DataFrame, items: str, words: DataFrame, name: str, row_key: Sequence[str] = ()) -> DataFrame:
    """Vocabulary index of every item, 0 for unseen ones."""
    return map_items(frame, items, words, "idx", name, default=0, row_key=row_key)


def decode(frame: DataFrame, indices: str, words: DataFrame, name: str, row_key: Sequence[str] = ()) -> DataFrame:
    """Item id of every vocabulary index, NULL for 0."""
    return map_items(frame, indices, words, "id", name, key="idx", row_key=row_key)


def with_offsets(dimension: DataFrame) -> DataFrame:
    cases = " ".join(f"WHEN '{rarity}' THEN {offset}" for rarity, offset in RARITY_OFFSETS.items())
    return dimension.selectExpr("id", f"CASE lower(rarity) {cases} END AS level_offset")


def displayed_levels(
    frame: DataFrame,
    dimension: DataFrame,
    cards: str = "deck",
    levels: str = "levels",
    name: str = "displayed",
    row_key: Sequence[str] = (),
) -> DataFrame:
    """Level plus the rarity offset of each card; NULL where card or rarity is unknown."""
    looked = map_items(frame, cards, with_offsets(dimension), "level_offset", "__offsets", row_key=row_key)
    return looked.withColumn(name, F.expr(f"zip_with({levels}, __offsets, (l, o) -> l + o)")).drop("__offsets")


def read_dimension(spark: SparkSession, path: str, key: str = "id", rarity: str = "rarity", label: str = "name") -> DataFrame:
    """Dimension (id, rarity, name) from a Parquet folder or CSV files with a header; ``name`` may be absent.

    Runs an action: ids must be whole numbers, present and unique, rarities supported.
    """
    is_csv = path.rstrip("/").endswith(".csv")
    stored = spark.read.option("header", True).csv(path) if is_csv else spark.read.parquet(path)
    missing = [c for c in (key, rarity) if c not in stored.columns]
    if missing:
        raise ValueError(f"dimension lacks columns {missing}")
    names = F.col(label).cast("string") if label in stored.columns else F.lit(None).cast("string")
    cards = stored.select(F.col(key).try_cast("int").alias("id"), F.lower(rarity).alias("rarity"), names.alias("name"))
    bad = cards.filter(F.col("id").isNull() | ~F.coalesce(F.col("rarity").isin(*RARITY_OFFSETS), F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"dimension has unusable rows: {[r.asDict() for r in bad]}")
    require_unique(cards, "id")
    return cards


def named_items(frame: DataFrame, dimension: DataFrame, item: str = "card", name: str = "name") -> DataFrame:
    """``frame`` with the name of each row's item; NULL for an item without one. Left to Spark's size statistics."""
    return frame.join(dimension.select(F.col("id").alias(item), F.col("name").alias(name)), item, "left")
