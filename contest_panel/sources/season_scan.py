"""Season CSV files as a Spark data source: every task reads the headers of its own files.

Only the listing of the folder happens ahead of the scan; no file is opened on the driver. Files go to tasks in groups of
bounded size, columns are taken by each file's own header, columns and days that a query doesn't need are not read. A file without
a required column ends the query with its name. The store must be one that Arrow's file systems open (local or shared folders,
S3, GCS, HDFS); ``season.read_source`` reads any that Spark does, but opens every file on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StringType, StructField, StructType

from contest_panel.session import ship
from contest_panel.sources.season import BATTLE_FILES, FILE_DAY, _narrowed, fold_numbered, source_columns

#: Bytes, and number, of files that a task reads.
TASK_BYTES = 64_000_000
TASK_FILES = 500
_BLOCK = 4_000_000


@dataclass
class Files(InputPartition):
    """Files of one task with their days."""

    files: tuple[tuple[str, str], ...]

    def __init__(self, files: tuple[tuple[str, str], ...]):
        super().__init__(None)
        self.files = files


def open_folder(path: str):
    """(Arrow file system, path inside it) of a folder named by a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def listed(path: str, files: str, day: str) -> list[tuple[str, str, int]]:
    """(file, day, size) of the files below ``path`` whose path the pattern ``files`` matches, in order."""
    from pyarrow import fs

    system, root = open_folder(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        if info.is_file and re.search(files, info.path) and not info.base_name.startswith(("_", ".")):
            match = re.search(day, info.path)
            found.append((info.path, match.group(1) if match else "", info.size))
    return sorted(found)


class SeasonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.files, self.day = options["path"], options.get("files", BATTLE_FILES), options.get("day", FILE_DAY)
        self.columns = tuple(c for c in options["columns"].split("\n") if c)
        self.wanted: list[Filter] = []

    def _takes(self, day: str) -> bool:
        tests = {
            EqualTo: lambda v: day == v, In: lambda v: day in v, StringContains: lambda v: v in day,
            StringStartsWith: day.startswith, StringEndsWith: day.endswith,
        }
        return all(tests[type(f)](f.value) for f in self.wanted)

    def partitions(self) -> Sequence[InputPartition]:
        groups: list[list[tuple[str, str]]] = []
        held = 0
        for file, day, size in listed(self.path, self.files, self.day):
            if not self._takes(day):
                continue
            if not groups or held + size > TASK_BYTES or len(groups[-1]) >= TASK_FILES:
                groups.append([])
                held = 0
            groups[-1].append((file, day))
            held += size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        for file, day in partition.files:
            with system.open_input_stream(file, compression="detect") as stream:
                yield from read_file(stream, file, day, self.columns)


class DayReader(SeasonReader):
    """Chooses files by filters on the day; Spark allows this method only where it pushes filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the day choose files; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringContains, StringStartsWith, StringEndsWith)) and tuple(f.attribute) == ("day",):
                self.wanted.append(f)
            else:
                yield f


def read_file(stream, file: str, day: str, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the day and the named columns as text; empty fields are NULL."""
    from pyarrow import csv

    text = csv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()), strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
    try:
        batches = csv.open_csv(stream, csv.ReadOptions(block_size=_BLOCK), csv.ParseOptions(newlines_in_values=False), text)
    except pa.ArrowInvalid as error:  # not even a header
        raise ValueError(f"season source lacks required columns: {list(columns)} in {file} ({error})") from error
    absent = [c for c in columns if c not in batches.schema.names]
    if absent:
        raise ValueError(f"season source lacks required columns: {absent} in {file}")
    for batch in batches:
        own = [batch.column(batch.schema.get_field_index(c)).cast(pa.string()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([day] * batch.num_rows, pa.string()), *own], ["day", *columns])


class SeasonCsv(DataSource):
    """``spark.read.format("season_csv")`` with options path, files, day and columns (one per line)."""

    @classmethod
    def name(cls) -> str:
        return "season_csv"

    def schema(self) -> StructType:
        names = ["day", *(c for c in self.options["columns"].split("\n") if c)]
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (DayReader if options.get("push") == "true" else SeasonReader)(options)


def scan_source(
    spark: SparkSession, path: str, files: str = BATTLE_FILES, day: str = FILE_DAY, columns: Sequence[str] | None = None
) -> DataFrame:
    """The needed columns of season CSV files with ``day`` from their path, like ``season.read_source``. Lists the folder once.

    ``columns`` reads only some of the source's columns, as they are named there, without folding cards into arrays. Set
    ``spark.sql.python.filterPushdown.enabled`` so that filters on ``day`` choose the files to open.
    """
    ship(spark)
    chosen = list(columns or source_columns())
    if not listed(path, files, day):
        raise FileNotFoundError(f"no season files matching {files} in {path}")
    spark.dataSource.register(SeasonCsv)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    read = spark.read.format("season_csv").options(path=path, files=files, day=day, columns="\n".join(chosen), push=push).load()
    typed = read.select("day", *[_narrowed(c).alias(c) for c in chosen])
    return typed if columns else fold_numbered(typed)
