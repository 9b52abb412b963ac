"""Connected components of a distributed edge list, and tables stored between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from contest_panel.operators.skew import join_on_key
from contest_panel.session import checkpoint_folder

#: Rows up to which a table of keys is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Neighbours from which a node is a hub: its edges are spread over tasks.
HUB_EDGES = 500


def stored(frame: DataFrame, file_rows: int = 0) -> DataFrame:
    """``frame`` written as Parquet in the session's checkpoint folder and read back (an action).

    Files have at most ``file_rows`` rows, if that is given.
    """
    path = f"{checkpoint_folder(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return frame.sparkSession.read.parquet(path)


def _with_least(edges: DataFrame, least: DataFrame, hub_edges: int) -> DataFrame:
    """``edges`` with the ``m`` of their ``a`` from ``least`` (a, m, n: one row per a); hubs are salted."""
    hubs = least.filter(F.col("n") >= hub_edges).select("a")  # one for every ``hub_edges`` edges at most
    found = hubs.count()
    hot = (F.broadcast(hubs) if found <= BROADCAST_ROWS else hubs) if found else None
    return join_on_key(edges, least.select("a", "m"), "a", "inner", hot, "b")


def components(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b): label is the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes, a logarithmic number of rounds; each
    round is two aggregations with map-side combine and two joins. Hubs are counted by the aggregations, and
    their edges are salted in the joins, so neither groups nor joins put a hub in one task. Runs actions.
    """
    edges = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        seen = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = _with_least(both.filter(F.col("b") > F.col("a")), least, hub_edges)
        large = stored(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct())
        smallest = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = _with_least(large, smallest, hub_edges).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
