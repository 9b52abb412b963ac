"""Array expressions on item sets (decks) and their aligned levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import as_column

DECK_SIZE = 8
DECK_BASE = 128

# Levels every rarity starts above the common scale.
RARITY_OFFSETS = {"common": 0, "rare": 2, "epic": 5, "legendary": 8, "champion": 10}


def rarity_offset(rarity: str | Column) -> Column:
    """Level offset of a rarity name, NULL for an unsupported one."""
    pairs = [part for name, offset in RARITY_OFFSETS.items() for part in (F.lit(name), F.lit(offset))]
    return F.try_element_at(F.create_map(*pairs), F.lower(as_column(rarity)))


def total_of(values: str | Column) -> Column:
    """Row-wise sum of an integer array."""
    return F.aggregate(as_column(values), F.lit(0), lambda acc, x: acc + x)


def deck_total(values: str, size: int = DECK_SIZE) -> str:
    """SQL sum of an array of exactly ``size`` integers.

    Spelled out, so it stays in generated code; a lambda would be interpreted row by row.
    """
    return "(" + " + ".join(f"get({values}, {i})" for i in range(size)) + ")"


def packed_deck(indices: str | Column) -> Column:
    """Sorted item indices (1 to 127, 0 for unseen) packed into one bigint, lowest index in the lowest digit.

    An index outside that range, or a deck too large for the bigint, is an error rather than another deck's key.
    """
    indices = as_column(indices)
    ordered = F.sort_array(indices, asc=False)
    packed = F.aggregate(ordered, F.lit(0).cast("bigint"), lambda acc, x: acc * F.lit(DECK_BASE) + x.cast("bigint"))
    fits = (F.array_max(indices) < DECK_BASE) & (F.array_min(indices) >= 0) & (F.size(indices) <= DECK_SIZE)
    return F.when(fits | (F.size(indices) == 0), packed).when(
        ~fits, F.raise_error(F.lit("deck index does not fit the packed key")).cast("bigint")
    )


def is_full_deck(cards: str | Column, size: int = DECK_SIZE) -> Column:
    """True for exactly ``size`` distinct items."""
    cards = as_column(cards)
    return F.coalesce((F.size(cards) == size) & (F.size(F.array_distinct(cards)) == size), F.lit(False))


def jaccard_distance(left: str | Column, right: str | Column) -> Column:
    """1 − |A∩B| / |A∪B|; NULL when both sets are empty or one is missing."""
    left, right = as_column(left), as_column(right)
    union = F.size(F.array_union(left, right))
    return F.when(
        left.isNotNull() & right.isNotNull() & (union > 0),
        1.0 - F.size(F.array_intersect(left, right)) / union,
    )


def shared_items(left: str | Column, right: str | Column) -> Column:
    return F.size(F.array_intersect(as_column(left), as_column(right)))


def drift_of(shared: str | Column, size: int = DECK_SIZE) -> Column:
    """Distance between two full decks from their overlap."""
    shared = as_column(shared)
    return 1.0 - shared / (F.lit(2 * size) - shared)
