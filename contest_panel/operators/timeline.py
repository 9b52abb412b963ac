"""Per-entity ordered histories that stay parallel when one entity owns a large share of the rows.

A window partitioned by entity puts the whole history of an entity in one task. Entities above
``hot_rows`` are therefore cut into segments of consecutive rows: the rank of a row in the global
(entity, time, key) order fixes its segment, the ``halo`` rows before a segment are repeated in it
for look-back frames, and totals of earlier segments are carried in for running aggregates. Results
equal those of the plain window. Ordinary entities take the plain window: one shuffle, one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from contest_panel.functions.scalars import as_column
from contest_panel.operators.ranking import global_rank
from contest_panel.operators.skew import DEFAULT_HOT_ROWS, hot_keys

SEGMENT = "__segment"
HALO = "__halo"


@dataclass(frozen=True)
class Timeline:
    """Rows plus the window specification that walks each entity's history."""

    rows: DataFrame
    entity: str
    order: tuple[str, ...]
    split: bool

    @property
    def keys(self) -> list[str]:
        return [self.entity, SEGMENT] if self.split else [self.entity]

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.order)

    def upto(self, *extra: str) -> WindowSpec:
        return self.window(*extra).rowsBetween(Window.unboundedPreceding, 0)

    def own(self, value: str | Column) -> Column:
        """``value`` on rows that belong to the segment, NULL on repeated ones."""
        value = as_column(value)
        return F.when(~F.col(HALO), value) if self.split else value

    def on(self, rows: DataFrame) -> Timeline:
        return Timeline(rows, self.entity, self.order, self.split)

    def running(self, name_to_value: Mapping[str, str | Column], how: str = "sum", per: Sequence[str] = ()) -> Timeline:
        """Add inclusive running sums or maxima of each value along the history (per extra key)."""
        combine = {"sum": F.sum, "max": F.max}[how]
        inputs = {f"__in_{n}": self.own(v) for n, v in name_to_value.items()}
        rows = self.rows.withColumns(inputs)
        spec = self.upto(*per)
        if not self.split:
            filled = {n: combine(f"__in_{n}").over(spec) for n in name_to_value}
            if how == "sum":
                filled = {n: F.coalesce(c, F.lit(0)) for n, c in filled.items()}
            return self.on(rows.withColumns(filled).drop(*inputs))
        keys = [self.entity, *per, SEGMENT]
        parts = rows.filter(F.col(SEGMENT) >= 0).groupBy(*keys).agg(*[combine(c).alias(c) for c in inputs])
        earlier = (
            Window.partitionBy(self.entity, *per).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = parts.select(*keys, *[combine(c).over(earlier).alias(f"__c{c}") for c in inputs])
        rows = rows.join(carried, keys, "left")
        filled = {}
        for n in name_to_value:
            inside, before = combine(f"__in_{n}").over(spec), F.col(f"__c__in_{n}")
            if how == "sum":
                filled[n] = F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
            else:
                filled[n] = F.greatest(before, inside)
        return self.on(rows.withColumns(filled).drop(*inputs, *[f"__c{c}" for c in inputs]))

    def result(self) -> DataFrame:
        """Rows without repeated ones and helper columns."""
        if not self.split:
            return self.rows
        return self.rows.filter(~F.col(HALO)).drop(SEGMENT, HALO)


def build_timeline(
    frame: DataFrame,
    entity: str,
    order: Sequence[str],
    halo: int = 1,
    hot_rows: int = DEFAULT_HOT_ROWS,
    segment_rows: int | None = None,
) -> Timeline:
    """Timeline of ``frame``; one counting action looks for hot entities.

    ``order`` must be total within an entity. Pass stored input when its lineage is expensive.
    """
    hot = hot_keys(frame, entity, hot_rows)
    if hot is None:
        return Timeline(frame, entity, tuple(order), False)
    ranked = global_rank(frame.join(hot, entity, "left_semi"), [entity, *order], "__pos")
    length = max(segment_rows or hot_rows, halo + 1)
    zero_based = F.col("__pos") - 1
    segment = F.floor(zero_based / F.lit(length)).cast("bigint")
    homes = F.array(F.struct(segment.alias("s"), F.lit(False).alias("h")))
    if halo:
        again = F.array(F.struct((segment + 1).alias("s"), F.lit(True).alias("h")))
        homes = F.when(zero_based % length >= length - halo, F.concat(homes, again)).otherwise(homes)
    pieces = (
        ranked.withColumn("__home", F.explode(homes))
        .withColumns({SEGMENT: F.col("__home.s"), HALO: F.col("__home.h")})
        .drop("__home", "__pos")
    )
    rest = frame.join(hot, entity, "left_anti").withColumns(
        {SEGMENT: F.lit(-1).cast("bigint"), HALO: F.lit(False)}
    )
    return Timeline(rest.unionByName(pieces), entity, tuple(order), True)
