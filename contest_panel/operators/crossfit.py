"""Logistic models for all folds at once: every pass over the rows moves the models of all "all but this fold" samples.

Iteratively reweighted least squares: a pass adds up, for each fold's model, the Gram matrix and gradient over the rows outside
the fold, in its own standardisation. Tasks sum over Arrow batches, sums of tasks are added per fold on executors, and one
row per fold reaches the driver, which solves for the next coefficients. So the number of jobs follows the number of Newton
steps (a handful) instead of folds times steps. The Gram matrix limits the width: :data:`WIDTH_LIMIT` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from contest_panel.session import ship

#: Columns of a model at most: a task holds one matrix of this size squared per fold.
WIDTH_LIMIT = 2_048


@dataclass(frozen=True)
class FoldModels:
    """One model per fold: ``shift`` and ``scale`` standardise (values are (raw - shift) * scale, missing ones 0);
    ``weights`` has a column per feature and the intercept last. ``losses``: penalised mean loss of each round, by fold."""

    folds: tuple[int, ...]
    shift: np.ndarray
    scale: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    losses: tuple[tuple[float, ...], ...] = ()
    products: int = 0

    def scaled(self, dense: np.ndarray, at: int) -> np.ndarray:
        """Standardised dense columns of the ``at``-th model, which may take the first ones only; missing values are 0."""
        x = (dense[:, : self.shift.shape[1]] - self.shift[at]) * self.scale[at]
        return np.where(np.isnan(x), 0.0, x)

    def inputs(self, dense: np.ndarray, counts: np.ndarray, at: int, action: np.ndarray | None = None) -> np.ndarray:
        """Rows of features of the ``at``-th model, a column of ones last.

        With an action, it and its products with the first ``products`` columns follow the dense ones.
        """
        x = self.scaled(dense, at)
        acted = [] if action is None else [action[:, None], x[:, : self.products] * action[:, None]]
        return np.hstack([x, *acted, counts, np.ones((len(x), 1))])


def _dense(batch: pa.RecordBatch) -> np.ndarray:
    """Dense values of a batch with a column ``dense``, NaN where NULL."""
    lists = batch.column(batch.schema.get_field_index("dense"))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _known_items(batch: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and word of every item of a batch with a column ``items`` that is one of ``words``."""
    items = batch.column(batch.schema.get_field_index("items"))
    row = np.repeat(np.arange(batch.num_rows), items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    values = items.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(words, values), len(words) - 1)
    known = words[place] == values
    return row[known], place[known]


def _raw(batch: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense values (NaN where NULL) and item counts of a batch with columns ``dense`` and ``items``."""
    counts = np.zeros((batch.num_rows, len(words)))
    if len(words):
        row, place = _known_items(batch, words)
        counts = np.bincount(row * len(words) + place, minlength=counts.size).reshape(counts.shape).astype(np.float64)
    return _dense(batch), counts


def _logit(models: FoldModels, batch: pa.RecordBatch, action: np.ndarray | None = None) -> np.ndarray:
    """Log-odds by the first model; item weights are added up without a matrix of counts."""
    x, w = models.scaled(_dense(batch), 0), models.weights[0]
    at = x.shape[1]
    total = x @ w[:at] + w[-1]
    if action is not None:
        total += action * (w[at] + x[:, : models.products] @ w[at + 1 : at + 1 + models.products])
        at += 1 + models.products
    if len(models.words):
        row, place = _known_items(batch, models.words)
        total += np.bincount(row, weights=w[at:-1][place], minlength=batch.num_rows)
    return total


def _action(batch: pa.RecordBatch) -> np.ndarray | None:
    at = batch.schema.get_field_index("action")
    return None if at < 0 else batch.column(at).to_numpy(zero_copy_only=False).astype(np.float64)


def _per_fold_sums(rows: DataFrame, models: FoldModels, work: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Sum of ``work(inputs, labels, fold place)`` over the rows outside each fold: one flat array per fold (an action)."""
    ship(rows.sparkSession)
    shipped = rows.sparkSession.sparkContext.broadcast(models)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        total: list[np.ndarray | None] = [None] * len(own.folds)
        for batch in batches:
            if not batch.num_rows:
                continue
            dense, counts = _raw(batch, own.words)
            action = _action(batch)
            fold, label = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("fold", "label"))
            for at, number in enumerate(own.folds):
                outside = fold != number
                if outside.any():
                    acted = None if action is None else action[outside]
                    found = work(own.inputs(dense[outside], counts[outside], at, acted), label[outside].astype(np.float64), at)
                    total[at] = found if total[at] is None else total[at] + found
        made = [(at, t) for at, t in enumerate(total) if t is not None]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.int32()), pa.array([t for _, t in made], pa.list_(pa.float64()))], ["at", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[at] = total.get(at, 0.0) + sums.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["at", "sums"])

    schema = "at int, sums array<double>"
    needed = [c for c in ("fold", "label", "dense", "items", "action") if c in rows.columns and (c != "items" or len(models.words))]
    found = rows.select(*needed).mapInArrow(partial, schema).repartition("at").mapInArrow(added, schema).toArrow()
    by_fold = dict(zip(found.column(0).to_pylist(), found.column(1)))
    missing = [f for at, f in enumerate(models.folds) if at not in by_fold]
    if missing:
        raise ValueError(f"no rows outside folds {missing}")
    return np.array([by_fold[at].values.to_numpy() for at in range(len(models.folds))])


def fit_fold_models(
    rows: DataFrame,
    folds: Sequence[int],
    shift: np.ndarray,
    scale: np.ndarray,
    words: Sequence[int] = (),
    penalty: float = 1e-3,
    tolerance: float = 1e-7,
    max_rounds: int = 30,
    products: int = 0,
) -> FoldModels:
    """Fit one model per fold on the rows outside it. Runs an action per round, and one before.

    ``rows``: fold, label (0 or 1), ``dense`` (arrays of one length, NULL values allowed) and ``items`` (counted by ``words``, others are
    ignored). The objective is the mean loss plus ``penalty`` / 2 times the squares of the weights per standard deviation of
    their columns, without the intercept; columns that don't vary outside a fold keep weight 0. A Newton step that would raise
    the loss is halved. Rounds end when no fold's loss falls by more than ``tolerance``. Models take as many dense columns as
    ``shift`` has. A column ``action`` enters with its products with the first ``products`` of them.
    """
    words = np.sort(np.asarray(words, np.int64))
    width = shift.shape[1] + (1 + products if "action" in rows.columns else 0) + len(words) + 1
    if width > WIDTH_LIMIT:
        raise ValueError(f"{width} columns; the Gram matrices take at most {WIDTH_LIMIT}")
    models = FoldModels(tuple(folds), shift, scale, words, np.zeros((len(folds), width)), products=products)
    moments = _per_fold_sums(rows, models, lambda x, y, at: np.concatenate([x.sum(0), (x * x).sum(0)]))
    n = moments[:, width - 1]
    mean = moments[:, :width] / n[:, None]
    variance = np.maximum(moments[:, width:] / n[:, None] - mean**2, 0) * (n / np.maximum(n - 1, 1))[:, None]
    flat = variance <= 1e-12 * np.maximum(1.0, mean**2)
    flat[:, -1] = False
    ridge = penalty * variance
    ridge[:, -1] = 0.0

    step = np.zeros_like(models.weights)
    losses: list[tuple[float, ...]] = []
    best, held = np.full(len(folds), np.inf), models.weights
    for _ in range(max_rounds):
        current = FoldModels(models.folds, shift, scale, words, held + step, products=products)

        def work(x: np.ndarray, y: np.ndarray, at: int, weights: np.ndarray = current.weights) -> np.ndarray:
            logit = x @ weights[at]
            p = 1 / (1 + np.exp(-logit))
            loss = (np.logaddexp(0, logit) - y * logit).sum()
            return np.concatenate([[loss], x.T @ (y - p), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])

        sums = _per_fold_sums(rows, current, work)
        loss = sums[:, 0] / n + (ridge * current.weights**2).sum(1) / 2
        worse = loss > best + 1e-15
        fall = np.where(worse, np.inf, best - loss)
        held = np.where(worse[:, None], held, current.weights)
        best = np.where(worse, best, loss)
        losses.append(tuple(best.tolist()))
        if (fall <= tolerance).all():
            break
        for at in range(len(folds)):
            if worse[at]:
                step[at] /= 2
                continue
            slope = sums[at, 1 : width + 1] / n[at] - ridge[at] * held[at]
            bend = sums[at, width + 1 :].reshape(width, width) / n[at] + np.diag(ridge[at])
            kept = ~flat[at]
            step[at] = 0.0
            step[at, kept] = np.linalg.lstsq(bend[np.ix_(kept, kept)], slope[kept], rcond=None)[0]
    return FoldModels(models.folds, shift, scale, words, held, tuple(losses), products)


def column_moments(rows: DataFrame, fold: str = "fold") -> dict[int, np.ndarray]:
    """For each fold (count, mean, sum of squared deviations) of every entry of ``dense``, missing ones left out (an action).

    Tasks combine batches and send three numbers per column and fold.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                dense = _dense(batch)
                folds = batch.column(batch.schema.get_field_index(fold)).to_numpy()
                for number in np.unique(folds):
                    own = dense[folds == number]
                    n = (~np.isnan(own)).sum(axis=0).astype(np.float64)
                    mean = np.nansum(own, axis=0) / np.maximum(n, 1)
                    found = np.array([n, mean, np.nansum((own - mean) ** 2, axis=0)])
                    total[int(number)] = merged_moments(total[int(number)], found) if int(number) in total else found
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64()))], ["fold", "m"])

    found: dict[int, np.ndarray] = {}
    for row in rows.select(F.col(fold).cast("int").alias(fold), "dense").mapInArrow(run, "fold int, m array<double>").collect():
        m = np.array(row["m"]).reshape(3, -1)
        found[row["fold"]] = merged_moments(found[row["fold"]], m) if row["fold"] in found else m
    return found


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, mean and squared deviations (by row) of two samples together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    gap = b[1] - a[1]
    return np.array([n, a[1] + gap * share, a[2] + b[2] + gap * gap * a[0] * share])


def own_fold_scores(rows: DataFrame, models: FoldModels, keep: Sequence[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` and the probability by the model of each row's own fold, which never saw it. One pass over Arrow batches."""
    ship(rows.sparkSession)
    shipped = rows.sparkSession.sparkContext.broadcast(models)
    schema = StructType([*[rows.schema[c] for c in keep], StructField(name, DoubleType())])
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            dense, counts = _raw(batch, own.words)
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy()
            score = np.full(batch.num_rows, np.nan)
            for at, number in enumerate(own.folds):
                inside = fold == number
                if inside.any():
                    score[inside] = 1 / (1 + np.exp(-own.inputs(dense[inside], counts[inside], at) @ own.weights[at]))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], schema=wanted)

    needed = list(dict.fromkeys([*keep, "fold", "dense", "items"]))
    return rows.select(*needed).mapInArrow(run, schema)


def model_scores(
    rows: DataFrame, models: Sequence[FoldModels], keep: Sequence[str], names: Sequence[str], actions: Sequence[float | None] | None = None
) -> DataFrame:
    """Columns ``keep`` and the probability by the first model of each of ``models``, all in one pass over Arrow batches.

    A model with an action takes it from the column ``action``, or the number given for it in ``actions``.
    """
    ship(rows.sparkSession)
    shipped = rows.sparkSession.sparkContext.broadcast(list(zip(models, actions or [None] * len(models))))
    schema = StructType([*[rows.schema[c] for c in keep], *[StructField(n, DoubleType()) for n in names]])
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for own, given in shipped.value:
                action = None if not own.products else _action(batch) if given is None else np.full(batch.num_rows, given)
                found.append(pa.array(1 / (1 + np.exp(-_logit(own, batch, action)))))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *found], schema=wanted)

    needed = dict.fromkeys([*keep, "dense", *(["items"] if any(len(m.words) for m in models) else []), *([c for c in ("action",) if c in rows.columns])])
    return rows.select(*needed).mapInArrow(run, schema)


def scaled_rows(rows: DataFrame, models: FoldModels, keep: Sequence[str], logit: bool = False) -> DataFrame:
    """Columns ``keep``, ``scaled`` (the first model's standardised dense columns) and, if asked for, its log-odds ``logit``."""
    ship(rows.sparkSession)
    shipped = rows.sparkSession.sparkContext.broadcast(models)
    more = [StructField("logit", DoubleType())] if logit else []
    schema = StructType([*[rows.schema[c] for c in keep], StructField("scaled", ArrayType(DoubleType())), *more])
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = own.scaled(_dense(batch), 0)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            columns = [*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))]
            if logit:
                columns.append(pa.array(_logit(own, batch)))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, wanted)], schema=wanted)

    return rows.select(*dict.fromkeys([*keep, "dense", *(["items"] if logit and len(models.words) else [])])).mapInArrow(run, schema)
