"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from contest_panel.session import ship

#: Characters that one step of an operator holds at a time; a longer text is a step of its own.
STEP_CHARS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_part(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold an id belongs to (NULL ids: NULL)."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


def steps(batches: Iterator[pa.RecordBatch], text: str, chars: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (NULL as empty), each of about ``chars`` characters at most."""
    for part, column in slices_of(batches, text, chars):
        yield part, [t or "" for t in column.to_pylist()]


def slices_of(batches: Iterator[pa.RecordBatch], text: str, chars: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their text columns.

    Whole texts: a slice ends before the text that would pass the limit, and has one text at least.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64) + 1)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + chars, side="right")))
            part = batch.slice(first, last - first)
            yield part, column.slice(first, last - first)
            first = last


def map_texts(
    frame: DataFrame,
    keep: dict[str, str],
    text: str,
    schema: str,
    work: Callable[[Iterator[tuple[pa.RecordBatch, list[str]]]], Iterator[dict]],
    chars: int = STEP_CHARS,
) -> DataFrame:
    """Run ``work`` over slices of ``frame``; only the columns in ``keep`` and ``text`` travel to Python.

    ``keep`` maps names inside the slices to columns of the frame, so extra columns cannot clash with
    what an operator adds. ``work`` yields column dictionaries that fit ``schema``.
    """
    ship(frame.sparkSession)
    chosen = frame.select(*[F.col(f"`{column}`").alias(name) for name, column in keep.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    wanted = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(steps(batches, "__text", chars)):
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in wanted], schema=wanted
            )

    return chosen.mapInArrow(run, schema)


def to_arrow(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def filter_texts(
    frame: DataFrame, text: str, decide: Callable[[list[str]], tuple[np.ndarray, dict[str, list]]], chars: int = STEP_CHARS
) -> DataFrame:
    """Rows of ``frame`` that ``decide`` keeps, with all columns; it may also give new values for some columns.

    Each row is judged by itself, so repeated rows and repeated ids stay or go one by one.
    """
    ship(frame.sparkSession)
    wanted = to_arrow(frame.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, text, chars):
            mask, new = decide(texts)
            columns = [pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(wanted)]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted).filter(pa.array(mask))

    return frame.mapInArrow(run, frame.schema)
