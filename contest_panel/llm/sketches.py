"""Operator 8, document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's words are its runs without blanks (of ASCII); a shingle is ``WIDTH`` words, a shorter text is one
shingle. The sketch is the sorted array of the ``K`` smallest distinct 64-bit shingle hashes. Sketches of parts
merge to that of the whole; two sketches estimate resemblance and containment; one estimates how many distinct
shingles there are. A set of at most ``K`` shingles is kept whole, so then the estimates are exact.

Defined results: NULL and empty texts have the empty sketch, which resembles only an empty one (1.0); equal
texts have equal fingerprints; rows of equal id follow each other in order of text, NULL ids come first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from contest_panel.session import parallelism

K = 128
WIDTH = 5
_FIRST = -(1 << 63)


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, k: int = K, width: int = WIDTH) -> Column:
    """Sketch from a column of word hashes. The column must be materialised: every shingle looks into it."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))
    short = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(hashes)))
    return F.slice(F.array_sort(F.array_distinct(F.when(n >= width, runs).otherwise(short))), 1, k)


def with_sketch(frame: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``frame`` with the sketch of column ``text`` as column ``name``."""
    hashed = frame.withColumn("__words", word_hashes(F.coalesce(F.col(text), F.lit(""))))
    return hashed.withColumn(name, sketch_of(F.col("__words"), k, width)).drop("__words")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two materialised sketch columns."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    common = F.array_intersect(union, F.array_intersect(a, b))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(common) / F.size(union)).when(F.size(a) + F.size(b) == 0, 1.0).otherwise(0.0)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else by how far the k-th hash has come."""
    share = (F.element_at(sketch, -1).cast("double") - float(_FIRST)) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    near = resemblance(a, b, k)
    common = near / (near + 1) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge(frame: DataFrame, by: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of the union of each group's sketches (columns ``by`` and ``sketch``).

    Hashes beyond a group's k smallest are dropped in each task before the shuffle.
    """
    order = Window.partitionBy(by).orderBy("h")
    hashes = frame.select(by, F.explode(sketch).alias("h")).distinct()
    few = hashes.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    merged = few.groupBy(by).agg(F.array_sort(F.collect_list("h")).alias(sketch))  # k values of a group at most
    return frame.select(by).distinct().join(merged, by, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<bigint>")))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, ascending."""
    return F.lower(F.array_join(F.transform(sketch, F.hex), "."))


def with_next(frame: DataFrame, order: str, columns: dict[str, str], prepare) -> DataFrame:
    """``prepare(frame)`` with columns of the row after it in ascending ``order``; after the last comes the first.

    Rows go to buckets of consecutive ids, cut at approximate quantiles of the ids (one job over the ids). Each
    bucket also gets a copy of the first row of the bucket that follows, so a window inside buckets sees every
    neighbour and rows are shuffled once; ``prepare`` runs after that shuffle. Ids and bucket starts on the driver
    are as many as buckets, a few for each shuffle partition.
    """
    spark = frame.sparkSession
    buckets = 4 * parallelism(spark)
    place = F.coalesce(F.col(order).cast("long"), F.lit(_FIRST))
    shares = [i / buckets for i in range(1, buckets)]
    found = frame.select(F.percentile_approx(place, shares, max(10_000, 20 * buckets)).alias("b")).head()["b"] or []
    bounds = sorted(set(found))
    step = max(1, math.isqrt(len(bounds)))
    literal = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("__place")))
    coarse = below(literal(bounds[step - 1 :: step]))
    fine = below(F.slice(literal(bounds), coarse * step + 1, step))
    numbered = frame.withColumn("__place", place).withColumn("__bucket", coarse * step + fine)

    starts = sorted((r["__bucket"], r["first"]) for r in numbered.groupBy("__bucket").agg(F.min("__place").alias("first")).collect())
    before = [(first, starts[i - 1][0]) for i, (_, first) in enumerate(starts)]
    ghosts = F.broadcast(spark.createDataFrame(before or [(0, 0)], "__place long, __ghost_of int"))  # a row per bucket
    real = F.struct(F.col("__bucket").alias("bucket"), F.lit(False).alias("ghost"))
    copy = F.struct(F.col("__ghost_of").alias("bucket"), F.lit(True).alias("ghost"))
    homes = F.when(F.col("__ghost_of").isNull(), F.array(real)).otherwise(F.array(real, copy))
    dealt = numbered.join(ghosts, "__place", "left").withColumn("__home", F.explode(homes))
    dealt = dealt.withColumns({"__bucket": F.col("__home.bucket"), "__ghost": F.col("__home.ghost")}).drop("__home", "__ghost_of")
    prepared = prepare(dealt.repartition(buckets, "__bucket"))
    follows = Window.partitionBy("__bucket").orderBy("__ghost", "__place", *[c for c in columns.values() if c == "text"])
    leads = {name: F.lead(column).over(follows) for name, column in columns.items()}
    return prepared.withColumns(leads).filter("not __ghost").drop("__place", "__bucket", "__ghost")


def edited_pairs(frame: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and likenesses.

    The edited text has the last half of the code points (rounded down) replaced by as many of the first ones of
    the next document's text, in ascending order of ``key``, or all if it is shorter.
    """
    plain = frame.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = with_next(plain, "key", {"next_text": "text", "next_sketch": "sketch"}, lambda f: with_sketch(f, "text", "sketch", k))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch", k)
    return rows.select(
        F.col("key").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )
