"""Item co-occurrence, PMI, embeddings and neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from contest_panel.functions.decks import DECK_SIZE
from contest_panel.operators import spectral
from contest_panel.operators.orient import ladder_only
from contest_panel.session import materialise, parallelism, ship


def both_decks(battles: DataFrame) -> DataFrame:
    """The two decks of every battle as rows."""
    return battles.selectExpr("inline(array(named_struct('deck', a_cards), named_struct('deck', b_cards)))")


def item_universe(battles: DataFrame) -> DataFrame:
    """Distinct items over all rows, whatever the mode."""
    return battles.selectExpr("explode(concat(a_cards, b_cards)) AS card").distinct()


def cooccurrence(battles: DataFrame) -> DataFrame:
    """Ladder decks holding both items, for every ordered pair.

    Each deck yields its 28 unordered pairs, counted map-side; only the counts are mirrored.
    """
    pairs = ", ".join(
        f"named_struct('x', deck[{i}], 'y', deck[{j}])" for i in range(DECK_SIZE) for j in range(i + 1, DECK_SIZE)
    )
    counts = (
        both_decks(ladder_only(battles))
        .selectExpr("sort_array(deck) AS deck")
        .selectExpr(f"inline(array({pairs}))")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.selectExpr(
        "inline(array(named_struct('card_i', x, 'card_j', y, 'n', n), named_struct('card_i', y, 'card_j', x, 'n', n)))"
    )


def pmi(counts: DataFrame) -> DataFrame:
    """ln(n_ij · N / (n_i · n_j)) of observed pairs; negatives stay, absent pairs are absent (zero).

    Sizes here depend on the number of items, not of battles.
    """
    total = counts.select(F.sum("n")).scalar()
    return counts.select(
        "card_i",
        "card_j",
        "n",
        F.sum("n").over(Window.partitionBy("card_i")).alias("n_i"),
        F.sum("n").over(Window.partitionBy("card_j")).alias("n_j"),
        total.alias("total"),
    ).selectExpr("card_i", "card_j", "n", "ln(n * cast(total AS double) / (cast(n_i AS double) * n_j)) AS pmi")


def factorise(
    spark: SparkSession, pmi_rows: DataFrame, universe: DataFrame, dimensions: int, oversampling: int = 10, tolerance: float = 1e-10
) -> tuple[DataFrame, DataFrame]:
    """Singular vectors of the symmetric PMI matrix scaled by the root of the singular values. Runs actions.

    Returns (card, vector) and (k, singular_value, sign): the singular value is the size of an eigenvalue, ``sign`` its sign, so the
    products of two items' vectors, each dimension times its sign, add up to their PMI. There are as many dimensions as
    asked for, or as there are items; those beyond the rank of the matrix are zero, and so are vectors of items without
    pairs. Items stay in tables, so their number has no limit. Signs are fixed so the largest loading of each right singular
    vector is positive.
    """
    entries = pmi_rows.select(F.col("card_i").alias("i"), F.col("card_j").alias("j"), F.col("pmi").alias("value"))
    found = spectral.leading(entries, dimensions, oversampling, tolerance)
    width = min(dimensions, universe.count())
    values = np.r_[found.values, np.zeros(width - len(found.values))]
    basis = materialise(found.vectors)
    side = np.where(found.values < 0, -1.0, 1.0)
    turn = np.where(spectral.largest_loadings(basis, len(side)) * side < 0, -1.0, 1.0)
    scaling = np.zeros((len(side), width))
    scaling[np.arange(len(side)), np.arange(len(side))] = turn * np.sqrt(np.abs(found.values))
    scaled = spectral.turned(basis, scaling)
    vectors = universe.select(F.col("card").alias("i")).join(scaled, "i", "left").select(F.col("i").alias("card"), spectral.padded(F.col("vector"), width).alias("vector"))
    lines = [(k + 1, abs(float(v)), -1 if v < 0 else 1) for k, v in enumerate(values)]
    return vectors, spark.createDataFrame(lines, "k int, singular_value double, sign int")


def card_space(battles: DataFrame, dimensions: int = 16) -> tuple[DataFrame, DataFrame]:
    """Counts → PMI → factorisation in one call. Runs actions."""
    table = materialise(pmi(cooccurrence(battles)))
    return factorise(battles.sparkSession, table, item_universe(battles), dimensions)


def spectrum_report(spectrum: DataFrame, at: Sequence[int] = (1, 2, 4, 8, 12, 16, 24, 32, 48, 64)) -> DataFrame:
    """Singular value, share and cumulative share at selected ranks (one row per component)."""
    whole = Window.partitionBy(F.lit(0))
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return spectrum.select(
        "k",
        "singular_value",
        (F.col("singular_value") / F.sum("singular_value").over(whole)).alias("share"),
        (F.sum("singular_value").over(upto) / F.sum("singular_value").over(whole)).alias("cumulative"),
    ).filter(F.col("k").isin(*at))


def deck_vectors(decks: DataFrame, vectors: DataFrame, dimensions: int, deck: str = "deck") -> DataFrame:
    """Sum of the item vectors of each distinct deck: (deck, vector, missing).

    ``missing`` counts the deck's items without a vector; such a deck has no sum, its vector is NULL.
    """
    items = decks.select(F.col(deck).alias("deck")).distinct().select("deck", F.explode("deck").alias("card"))
    sums = [F.expr(f"sum(cast(vector[{d}] AS double))") for d in range(dimensions)]
    found = items.join(vectors, "card", "left").groupBy("deck").agg(F.array(*sums).alias("vector"), F.count_if(F.col("vector").isNull()).alias("missing"))
    return found.select("deck", F.when(F.col("missing") == 0, F.col("vector")).alias("vector"), "missing")


def difference_long(battles: DataFrame, key: Sequence[str]) -> DataFrame:
    """Difference design in long form: +1 for an item of side A, −1 for one of side B, shared items 0
    and left out. No shuffle: each battle yields its own entries."""
    entries = """filter(
        transform(array_union(a_cards, b_cards), c -> named_struct(
            'card', c, 'value', cast(array_contains(a_cards, c) AS int) - cast(array_contains(b_cards, c) AS int))),
        e -> e.value <> 0)"""
    return battles.selectExpr(*key, f"inline({entries})")


#: Items asked for whose products with a cell's vectors are held at once.
ASKED_AT_ONCE = 1_000
#: Vectors and items asked for in a cell of the grid at most, and vectors that a cell should have at least.
CELL_VECTORS, CELL_ASKED, CELL_LEAST = 32_768, 32_768, 512
#: Sums of products in another order are the same similarity.
DIGITS = 12


def nearest_items(vectors: DataFrame, named: DataFrame, k: int = 6, at_once: int = ASKED_AT_ONCE) -> DataFrame:
    """Top ``k`` cosine neighbours of each named item, itself excluded. Runs two counting actions.

    ``named`` holds the items asked for, of any type and number. Both tables are dealt by hash of the item, vectors into
    bands and items asked for into groups; every band meets every group in a cell of its own. A cell multiplies ``at_once`` of its
    asked vectors at a time with the others and keeps ``k`` rows for each, and the window merges cells. So nothing but the
    two counts passes the driver, memory is bounded by the cell, and the number of jobs does not depend on the items. A vector without length
    has no direction: no neighbours. NULL vectors and NULL items are left out; an item that is repeated must have one vector.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema["item"].dataType.simpleString()
    known = F.col("item").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    vectors = vectors.filter(known).select("item", F.col("vector").cast("array<double>").alias("vector"))
    wanted = named.select("item").distinct()
    bands, groups = _grid(vectors.count(), wanted.count(), parallelism(vectors.sparkSession))
    asked = vectors.join(wanted, "item", "left_semi")

    def dealt(rows: DataFrame, own: int, name: str, others: int, other: str) -> DataFrame:
        """Every row in its own band or group, once for each group or band of the other table."""
        place = F.pmod(F.xxhash64("item"), F.lit(own)).cast("int").alias(name)
        return rows.select(F.col("item").alias(f"{name}_item"), F.col("vector").alias(f"{name}_vector"), place, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    held = dealt(vectors, bands, "band", groups, "group").groupBy("band", "group")
    met = held.cogroup(dealt(asked, groups, "group", bands, "band").groupBy("band", "group"))
    scored = met.applyInArrow(_neighbours(k, at_once), f"query {kind}, item {kind}, similarity double")
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "item")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _grid(vectors: int, asked: int, tasks: int) -> tuple[int, int]:
    """Bands of vectors and groups of items asked for: cells of bounded size, enough of them, few copies of the rows."""
    even = round((tasks * vectors / max(1, asked)) ** 0.5)  # as many copies of the one table as of the other
    bands = max(1, -(-vectors // CELL_VECTORS), min(even, tasks, vectors // CELL_LEAST))
    return bands, max(1, -(-asked // CELL_ASKED), min(-(-tasks // bands), asked // CELL_LEAST))


def _neighbours(k: int, at_once: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def directed(table: pa.Table, name: str) -> tuple[pa.ChunkedArray, np.ndarray]:
        """Items and vectors of length one, in order of the items; those without a direction go."""
        table = table.select([f"{name}_item", f"{name}_vector"]).rename_columns(["item", "vector"]).sort_by("item")
        if not len(table):
            return table["item"], np.zeros((0, 0))
        rows = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        kept = np.flatnonzero(length[:, 0] > 0)
        return table["item"].take(pa.array(kept)), rows[kept] / length[kept]

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        (names, rows), (queries, wanted) = directed(held, "band"), directed(asked, "group")
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(names) and len(queries):
            every = pa.chunked_array([*names.chunks, *queries.chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            own, asking = every[: len(names)], every[len(names) :]
            once = np.flatnonzero(np.r_[True, asking[1:] != asking[:-1]])
            queries, wanted, asking = queries.take(pa.array(once)), wanted[once], asking[once]
            for first in range(0, len(queries), at_once):
                cosine = np.round(wanted[first : first + at_once] @ rows.T, DIGITS)
                sure = np.isin(asking[first : first + at_once], own)
                for line in np.flatnonzero(sure):
                    cosine[line, own == asking[first + line]] = -np.inf
                cosine[np.isnan(cosine)] = -np.inf
                if len(names) > k:
                    edge = np.partition(cosine, len(names) - k, axis=1)[:, len(names) - k, None]
                else:
                    edge = np.full((len(cosine), 1), -np.inf)
                line, at = np.nonzero((cosine >= edge) & (cosine > -np.inf))
                value = cosine[line, at]
                order = np.lexsort((at, -value, line))  # equal similarities by item, in whose order the vectors are
                line, at, value = line[order], at[order], value[order]
                nth = np.arange(len(line)) - np.searchsorted(line, line)
                found.append((first + line[nth < k], at[nth < k], value[nth < k]))
        query, item, value = (np.concatenate(x) for x in zip(*found))
        return pa.table([queries.take(pa.array(query, pa.int64())), names.take(pa.array(item, pa.int64())), pa.array(value)], ["query", "item", "similarity"])

    return run


def sign_checks(pmi_rows: DataFrame, expected: DataFrame) -> DataFrame:
    """PASS/FAIL of pre-registered PMI signs; ``expected``: card_i, card_j, sign. Absent pairs count as 0."""
    joined = expected.join(pmi_rows.select("card_i", "card_j", "pmi"), ["card_i", "card_j"], "left")
    return joined.selectExpr("card_i", "card_j", "sign", "coalesce(pmi, 0D) AS pmi").selectExpr(
        "*", "CASE WHEN (pmi < 0) = (sign = 'negative') THEN 'PASS' ELSE 'FAIL' END AS verdict"
    )
