"""Season tables: wide CSV source, canonical Parquet, conversion report."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from contest_panel.operators.orient import SEASON_FIELDS, canonicalise_season, neutral_sides, season_essentials

NUMBERS = range(1, 9)
SIDES = ("winner", "loser")
# Scalar side columns of the source and their canonical names.
SIDE_SCALARS = {
    "tag": "tag",
    "startingTrophies": "trophies",
    "crowns": "crowns",
    "kingTowerHitPoints": "king_hp",
    "clan.tag": "clan",
}
_TYPES = {"tag": T.StringType(), "clan.tag": T.StringType()}


def source_columns() -> list[str]:
    """Columns the season source must have."""
    names = ["battleTime", "gameMode.id", "arena.id"]
    for side in SIDES:
        for number in NUMBERS:
            names += [f"{side}.card{number}.id", f"{side}.card{number}.level"]
        names += [f"{side}.{scalar}" for scalar in SIDE_SCALARS]
    return names


def _type_of(column: str) -> T.DataType:
    if column == "battleTime":
        return T.StringType()
    return _TYPES.get(column.split(".", 1)[1], T.IntegerType())


def _narrowed(column: str) -> Column:
    """Text to the column's type; whole numbers may be written with a decimal point."""
    text, kind = F.col(f"`{column}`"), _type_of(column)
    return text if isinstance(kind, T.StringType) else text.try_cast("double").try_cast(kind)


#: Battle files of a season folder, and the day in their path: the file name up to its first dot.
BATTLE_FILES = r"\.csv(\.\w+)?$"
FILE_DAY = r"([^/.]+)[^/]*$"


def source_files(spark: SparkSession, path: str, files: str = BATTLE_FILES) -> list[str]:
    """Files below ``path`` (or itself) in whose path the pattern is found; other files of the tree, such as card lists, are passed over."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        raise FileNotFoundError(path)
    listed, found = system.listFiles(hadoop, True), []
    while listed.hasNext():
        place = listed.next().getPath()
        if re.search(files, place.toString()) and not place.getName().startswith(("_", ".")):
            found.append(place.toString())
    if not found:
        raise FileNotFoundError(f"no season files matching {files} in {path}")
    return sorted(found)


def header_of(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of one CSV file; only its first line is read."""
    java = spark._jvm
    place, conf = java.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration()
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = java.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        plain = stream if codec is None else codec.createInputStream(stream)
        line = java.java.io.BufferedReader(java.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").lstrip("\ufeff")]), ()))


def read_source(spark: SparkSession, path: str, files: str = BATTLE_FILES, day: str = FILE_DAY) -> DataFrame:
    """The needed columns of season CSV files, with ``day`` from their path. Reads one line of every file ahead.

    Columns go by each file's own header: files are read in groups of equal headers, and a file that lacks a
    required column is an error that names it. ``files`` selects files by their path, ``day`` finds the day in a path.
    Values are read as text and narrowed afterwards, so the CSV reader parses just the selected columns.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in source_files(spark, path, files):
        groups.setdefault(header_of(spark, file), []).append(file)
    read = None
    for header, own in groups.items():
        absent = [c for c in source_columns() if c not in header]
        if absent:
            raise ValueError(f"season source lacks required columns: {absent} in {own[:5]}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(own)
        typed = [_narrowed(c).alias(c) for c in source_columns()]
        part = rows.select(F.regexp_extract(F.col("_metadata.file_path"), day, 1).alias("day"), *typed)
        read = part if read is None else read.unionByName(part)
    return fold_numbered(read)


def fold_numbered(wide: DataFrame) -> DataFrame:
    """Fold the eight numbered card columns per side into arrays, NULL when one is missing."""
    columns: list[Column] = [
        F.col("battleTime"),
        F.col("`gameMode.id`").alias("game_mode"),
        F.col("`arena.id`").alias("arena"),
    ]
    for side in SIDES:
        for part, name in (("id", "cards"), ("level", "levels")):
            numbered = [f"`{side}.card{n}.{part}`" for n in NUMBERS]
            complete = " AND ".join(f"{c} IS NOT NULL" for c in numbered)
            columns.append(F.expr(f"CASE WHEN {complete} THEN array({', '.join(numbered)}) END AS {side}_{name}"))
        columns += [F.col(f"`{side}.{s}`").alias(f"{side}_{name}") for s, name in SIDE_SCALARS.items()]
    day = [F.col("day")] if "day" in wide.columns else []
    return wide.select(*day, *columns)


def flat_view(battles: DataFrame) -> DataFrame:
    """Canonical battles with the numbered ``a_card1`` … ``b_level8`` columns."""
    columns = [c for c in ("day", "battle_time", "game_mode", "arena", "a_won") if c in battles.columns]
    picked = [F.col(c) for c in columns]
    for side in "ab":
        for number in NUMBERS:
            picked.append(F.get(f"{side}_cards", F.lit(number - 1)).alias(f"{side}_card{number}"))
            picked.append(F.get(f"{side}_levels", F.lit(number - 1)).cast("tinyint").alias(f"{side}_level{number}"))
        picked += [F.col(f"{side}_{f}") for f in SEASON_FIELDS if f not in ("cards", "levels")]
    return battles.select(*picked)


def from_flat_view(flat: DataFrame) -> DataFrame:
    """Inverse of :func:`flat_view`."""
    picked = [F.col(c) for c in ("day", "battle_time", "game_mode", "arena", "a_won") if c in flat.columns]
    for side in "ab":
        picked.append(F.array(*[F.col(f"{side}_card{n}") for n in NUMBERS]).alias(f"{side}_cards"))
        picked.append(F.array(*[F.col(f"{side}_level{n}").cast("int") for n in NUMBERS]).alias(f"{side}_levels"))
        picked += [F.col(f"{side}_{f}") for f in SEASON_FIELDS if f not in ("cards", "levels")]
    return flat.select(*picked)


def conversion_report(source: DataFrame) -> DataFrame:
    """Rows read, rows written and side-A win rate per day, in one scan of the source."""
    whole = " AND ".join(f"{column} IS NOT NULL" for column in season_essentials())
    a_won = F.when(F.expr(whole), F.expr("cast(winner_tag < loser_tag AS int)"))
    return source.groupBy("day").agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.expr(whole)).alias("rows_written"), F.avg(a_won).alias("side_a_win_rate")
    )


def convert(source: DataFrame, destination: str, force: bool = False) -> DataFrame:
    """Write canonical battles as zstd Parquet by day and return the conversion report.

    Days already stored are skipped unless ``force``, which replaces just the days of the source. The source is scanned twice: for
    the rows and for the report.
    """
    spark = source.sparkSession
    if not force:
        stored = stored_days(spark, destination)
        if stored is not None:
            source = source.join(stored, "day", "left_anti")
    # Rebalancing brings the rows of a day together and splits a day that is too large for one file.
    writer = flat_view(canonicalise_season(source)).hint("rebalance", "day")
    (
        writer.write.mode("overwrite" if force else "append")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(destination)
    )
    return conversion_report(source)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored_days(spark: SparkSession, destination: str) -> DataFrame | None:
    """Days present at the destination, from partition values alone."""
    if not path_exists(spark, destination):
        return None
    return _by_day(spark, destination).select("day").distinct()


def _by_day(spark: SparkSession, path: str) -> DataFrame:
    """Stored days with ``day`` as text: inferred as a number, a name such as 01042021 would lose its zero."""
    inferred = spark.read.option("basePath", path).parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "day" else f for f in inferred])
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def read_days(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Stored days without those whose name contains an excluded token; the filter prunes partitions."""
    battles = _by_day(spark, path)
    for token in exclude:
        battles = battles.filter(~F.col("day").contains(token))
    if not battles.limit(1).count():
        raise FileNotFoundError(f"no season days in {path} after excluding {tuple(exclude)}")
    return from_flat_view(battles)


def read_season(
    spark: SparkSession, path: str, exclude: Sequence[str] = (), seed: int = 0, columns: Sequence[str] | None = None
) -> DataFrame:
    """Stored days with coin-assigned sides; only ``columns`` survive to the scan."""
    battles = neutral_sides(read_days(spark, path, exclude), seed)
    return battles.select(*columns) if columns else battles
