"""Leading eigenpairs of a large sparse symmetric matrix by randomised block power iteration.

The matrix is a table of entries (i, j, value), a block of vectors a table (i, vector). Multiplying is a join on j and a sum per i
with map-side combine. Only ``width`` × ``width`` matrices reach the driver: a block is orthonormalised through its Gram
matrix, twice for accuracy, and the Ritz values come from the projected matrix. So neither the number of rows nor of
entries has a limit, and every step can be recomputed from the table stored before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contest_panel.session import ship, stored

#: Gram eigenvalues below this share of the largest are directions that rounding made up.
_FLAT = 1e-13


@dataclass(frozen=True)
class Eigenpairs:
    """``vectors``: (i, vector), orthonormal columns in order of falling |value|; ``values``: eigenvalues; ``rounds`` needed."""

    vectors: DataFrame
    values: np.ndarray
    rounds: int


def times(entries: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """The matrix (i, j, value) times the block (i, vector); rows without entries are absent, as in sparse vectors."""
    met = entries.join(block.withColumnRenamed("i", "j"), "j")
    sums = [F.sum(F.col("value") * F.get("vector", F.lit(d))) for d in range(width)]
    return met.groupBy("i").agg(F.array(*sums).alias("vector"))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def gram(block: DataFrame, left: str, right: str) -> np.ndarray:
    """Sum over the rows of the outer products of two vector columns: one small matrix per task (an action)."""
    ship(block.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch.column(i), batch.num_rows) for i in (0, 1))
                total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()]), pa.array([len(total)])], ["m", "rows"])

    found = block.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInArrow(run, "m array<double>, rows long").collect()
    return sum((np.array(r["m"]).reshape(r["rows"], -1) for r in found), np.zeros((1, 1)))


def turned(block: DataFrame, matrix: np.ndarray, name: str = "vector") -> DataFrame:
    """Every row's vector times a small matrix."""
    return _mapped(block, name, lambda rows: rows @ matrix)


def _mapped(block: DataFrame, name: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    ship(block.sparkSession)
    kind = block.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = work(_matrix(batch.column(1), batch.num_rows))
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], ["i", "vector"])

    return block.select("i", name).mapInArrow(run, f"i {kind}, vector array<double>")


def _whitening(g: np.ndarray) -> np.ndarray:
    """Matrix that makes the columns behind a Gram matrix orthonormal; directions lost in rounding go."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    kept = values > _FLAT * values[-1]
    return vectors[:, kept] / np.sqrt(values[kept])


def orthonormal(block: DataFrame, g: np.ndarray) -> tuple[DataFrame, int]:
    """The block's column space as orthonormal columns, from its Gram matrix and once more from the result's (actions)."""
    once = stored(turned(block, _whitening(g)))
    second = _whitening(gram(once, "vector", "vector"))
    return turned(once, second), second.shape[1]


def seeded_block(rows: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """A reproducible random vector of ``width`` values in (-1, 1) for each row's ``i``."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.xxhash64(F.col("i"), d, F.lit(seed)) / F.lit(float(2**63)))
    return rows.select("i", draws.alias("vector"))


def leading(
    entries: DataFrame, k: int, oversampling: int = 10, tolerance: float = 1e-10, max_rounds: int = 100, seed: int = 0
) -> Eigenpairs:
    """The ``k`` eigenpairs of largest |value| of the symmetric matrix ``entries`` (i, j, value). Runs actions.

    Rounds go on until no wanted eigenvalue moves by more than ``tolerance`` of the largest; the error of a value shrinks with
    the square of that of its vector. A matrix of fewer rows than the block is wide is projected onto itself, so one
    round is exact. Fewer pairs are returned when the matrix has no more.
    """
    entries = stored(entries.filter("value <> 0").select("i", "j", "value"))
    rows = entries.select("i").distinct()
    n = rows.count()
    if not n:
        return Eigenpairs(entries.select("i", F.array().cast("array<double>").alias("vector")).limit(0), np.zeros(0), 0)
    width = min(k + oversampling, n)
    start = stored(seeded_block(rows, width, seed))
    block, width = orthonormal(start, gram(start, "vector", "vector"))
    before = None
    for round_number in range(1, max_rounds + 1):
        block = stored(block)
        moved = times(entries, block, width).withColumnRenamed("vector", "moved")
        both = stored(block.join(moved, "i"))
        projected = gram(both, "vector", "moved")
        values, inner = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:k]
        found = values[order]
        settled = before is not None and len(before) == len(found) and np.abs(np.abs(found) - np.abs(before)).max() <= tolerance * np.abs(found[0])
        if settled or width == n or round_number == max_rounds:
            return Eigenpairs(turned(block, inner[:, order]), found, round_number)
        before = found
        image = both.select("i", F.col("moved").alias("vector"))
        block, width = orthonormal(image, gram(image, "vector", "vector"))
    raise AssertionError("not reached")


def largest_loadings(block: DataFrame, width: int) -> np.ndarray:
    """For every column of the block the entry of largest absolute value, with its sign (an action)."""
    ship(block.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                rows = np.vstack([best, _matrix(batch.column(0), batch.num_rows)])
                best = rows[np.abs(rows).argmax(axis=0), np.arange(width)]
        yield pa.RecordBatch.from_arrays([pa.array([best])], ["best"])

    found = np.array([r["best"] for r in block.select("vector").mapInArrow(run, "best array<double>").collect()])
    return found[np.abs(found).argmax(axis=0), np.arange(width)] if len(found) else np.zeros(width)


def padded(vector: Column, width: int) -> Column:
    """``vector``, or zeros where it is NULL."""
    return F.coalesce(vector, F.array_repeat(F.lit(0.0), width))


def conjugate_gradient(
    entries: DataFrame, right: DataFrame, ridge: float, tolerance: float = 1e-8, max_rounds: int = 200
) -> DataFrame:
    """(i, value) that solves (matrix + ridge · diagonal count) x = right for a sparse symmetric positive matrix. Actions.

    ``entries``: (i, j, value); ``right``: (i, value). Preconditioned by the diagonal. Vectors stay tables; a round is one
    stored table and three sums for the driver.
    """
    shifted = entries.withColumn("value", F.col("value") + F.when(F.col("i") == F.col("j"), F.lit(ridge)).otherwise(F.lit(0.0)))
    matrix = stored(shifted)
    diagonal = matrix.filter(F.col("i") == F.col("j")).groupBy("i").agg(F.sum("value").alias("d"))
    state = stored(
        right.join(diagonal, "i").select("i", "d", F.lit(0.0).alias("x"), F.col("value").alias("r"), (F.col("value") / F.col("d")).alias("p"))
    )
    dot = state.agg(F.coalesce(F.sum(F.col("r") * F.col("r") / F.col("d")), F.lit(0.0))).head()[0]
    first = dot
    for _ in range(max_rounds):
        if dot <= tolerance * tolerance * first or not dot:
            break
        moved = matrix.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("p")).alias("ap"))
        both = stored(state.join(moved, "i"))
        ap = F.col("ap")
        bent, cross, own = both.agg(F.sum(F.col("p") * ap), F.sum(F.col("r") * ap / F.col("d")), F.sum(ap * ap / F.col("d"))).head()
        step = dot / bent if bent else 0.0
        if not math.isfinite(step) or not step:
            break
        fresh = max(0.0, dot - 2 * step * cross + step * step * own)  # the same sum for the next r
        rest = F.col("r") - step * ap
        state = both.select("i", "d", (F.col("x") + step * F.col("p")).alias("x"), rest.alias("r"), (rest / F.col("d") + (fresh / dot) * F.col("p")).alias("p"))
        dot = fresh
    return state.select("i", F.col("x").alias("value"))
