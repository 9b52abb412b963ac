"""Distributed global ranks, running sums and exact quantiles.

None of them sends a table through one task: rows are range-partitioned (which also splits a hot
leading key, because the bounds cover every ordering column) or spread over hash buckets, and only
per-partition or per-bucket totals are combined in one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from contest_panel.functions.scalars import as_column, seeded_digest
from contest_panel.session import materialise, parallelism

_SLOT = "__slot"
_PART = "__part"
_ROW_BITS = 33


def _placed(frame: DataFrame, order: Sequence[str | Column], partitions: int | None) -> DataFrame:
    """Range-partition and sort, stamp each row with (partition, row) and cut the lineage.

    The stamp must not be recomputed, since range bounds come from a sample; hence the checkpoint.
    """
    keys = [as_column(k) for k in order]
    placed = (
        frame.repartitionByRange(partitions or parallelism(frame.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SLOT, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(_SLOT, _ROW_BITS).cast("int"))
    )
    return materialise(placed)


def global_rank(
    frame: DataFrame, order: Sequence[str | Column], name: str = "rank", partitions: int | None = None
) -> DataFrame:
    """1-based rank over the whole table. ``order`` must be a total order. Runs an action."""
    placed = _placed(frame, order, partitions)
    # One row per partition, so the unpartitioned window and the broadcast are bounded by their number.
    totals = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    offsets = totals.select(_PART, (F.sum("__n").over(Window.orderBy(_PART)) - F.col("__n")).alias("__before"))
    row = F.col(_SLOT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("__before") + row + 1)
        .drop(_PART, _SLOT, "__before")
    )


def running_sums(
    frame: DataFrame,
    order: Sequence[str | Column],
    sums: Mapping[str, str | Column],
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running totals over the whole table in a total order. Runs an action."""
    inputs = {f"__v_{name}": as_column(expr) for name, expr in sums.items()}
    placed = _placed(frame.withColumns(inputs), order, partitions)
    totals = placed.groupBy(_PART).agg(*[F.sum(c).alias(c) for c in inputs])
    before = Window.orderBy(_PART)
    offsets = totals.select(_PART, *[(F.sum(c).over(before) - F.col(c)).alias(f"__b{c}") for c in inputs])
    inside = Window.partitionBy(_PART).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    columns = {name: F.col(f"__b__v_{name}") + F.sum(f"__v_{name}").over(inside) for name in sums}
    return (
        placed.join(F.broadcast(offsets), _PART)
        .withColumns(columns)
        .drop(_PART, _SLOT, *inputs, *[f"__b{c}" for c in inputs])
    )


def hashed_rank(
    frame: DataFrame,
    key: Sequence[str],
    seed: int | str,
    within: Sequence[str] = (),
    name: str = "rank",
    prefix: int = 3,
) -> DataFrame:
    """1-based rank in a seeded random order of distinct keys, optionally within few groups.

    Rows spread over ``16 ** prefix`` digest buckets per group, so a group holding most of the table
    is still ranked by many tasks. ``within`` must have few distinct values (bands, cells).
    """
    digest = seeded_digest(seed, *key)
    groups = list(within)
    marked = frame.withColumn("__digest", digest).withColumn("__bucket", F.substring("__digest", 1, prefix))
    totals = marked.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    ladder = Window.partitionBy(*groups).orderBy("__bucket")
    offsets = totals.select(*groups, "__bucket", (F.sum("__n").over(ladder) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy(*groups, "__bucket").orderBy("__digest", *key)
    return (
        marked.withColumn("__row", F.row_number().over(inside))
        .join(F.broadcast(offsets), [*groups, "__bucket"])
        .withColumn(name, F.col("__before") + F.col("__row"))
        .drop("__digest", "__bucket", "__row", "__before")
    )


def exact_quantiles(
    frame: DataFrame, columns: Iterable[str], probabilities: Sequence[float], partitions: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles, one row per (metric, probability). NULLs are skipped.

    Values are counted before anything is ordered, so repeated values cost one row each. Runs an action.
    """
    columns = list(columns)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    counted = (
        frame.select(pairs.alias("p"))
        .select("p.metric", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    summed = running_sums(counted, ["metric", "value"], {"upto": "n"}, partitions)
    # One row per metric: bounded by the column list.
    spans = summed.groupBy("metric").agg(
        F.min(F.col("upto") - F.col("n")).alias("start"), F.sum("n").alias("total")
    )
    place = F.col("probability") * (F.col("total") - 1)
    spots = spans.select(
        "metric", "start", "total", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    ).select("metric", "start", "probability", place.alias("place"), F.floor(place).alias("low"), F.ceil(place).alias("high"))
    first = F.col("upto") - F.col("n") - F.col("start")
    last = F.col("upto") - F.col("start")
    holds = lambda spot: (F.col(spot) >= first) & (F.col(spot) < last)
    picked = (
        summed.join(F.broadcast(spots), "metric")
        .filter(holds("low") | holds("high"))
        .groupBy("metric", "probability")
        .agg(
            F.max("place").alias("place"),
            F.max("low").alias("low"),
            F.max(F.when(holds("low"), F.col("value"))).alias("below"),
            F.max(F.when(holds("high"), F.col("value"))).alias("above"),
        )
    )
    return picked.select(
        "metric",
        "probability",
        (F.col("below") + (F.col("above") - F.col("below")) * (F.col("place") - F.col("low"))).alias("value"),
    )
