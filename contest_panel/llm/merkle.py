"""Operator 13, Merkle dataset manifest: hash trees over groups of rows, and a recursive climb that folds a claimed leaf.

Every row is a leaf. Leaves of a group, ascending by key, are hashed eight at a time, level by level, until one node is
left: the group's subroot. Subroots, ordered by group, are hashed in the same way into the root. The levels are stored
as node rows with a link to the parent, its children's digests and the place among them.

A Spark recursive query then climbs from all runs of leaves at once: in each step a row meets its parent, every leaf of the
run folds its own claimed hash with the original siblings, and the siblings are appended to the run's common proof. Leaves
of one run share all siblings but their own run's, so they travel in one row, and a proof is stored once for the run.

Digests are 32 bytes in tables and hexadecimal text when hashed. A place among all rows comes from a range partitioning
over (group, key, leaf), so a group with most of the rows is ranked and hashed by many tasks; no step gathers more than
``FAN`` children. Texts are hashed where they are read and never shuffled.

Defined results: NULL groups come first and are a group of their own, apart from empty ones; NULL keys come first in their
group; rows of equal key are ordered by leaf, equal leaves are interchangeable; a lone leaf is its subroot, a lone subroot
the root; a proof without siblings is the hash of nothing; an empty table gives no rows. Only the key, the group and the
hashes are kept, so columns of any other name don't matter. Very long texts are hashed whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contest_panel.llm.graph import stored
from contest_panel.operators.ranking import global_rank
from contest_panel.operators.skew import BROADCAST_KEYS, hot_keys, join_on_key
from contest_panel.session import row_count_up_to

FAN = 8
#: The tree number of the tree over subroots; groups are numbered by the rank of their first leaf.
TOP = -1
_ROWS = "spark.sql.cteRecursionRowLimit"


@dataclass(frozen=True)
class Manifest:
    """``runs``: runs of leaves, which are the lowest nodes. ``nodes``: all nodes above, linked to their parents."""

    runs: DataFrame
    nodes: DataFrame

    def root(self) -> bytes | None:
        """The digest of the only node without a parent, None for an empty table (an action)."""
        links = self.runs.select("digest", "parent").unionByName(self.nodes.select("digest", "parent"))
        top = links.filter(F.col("parent").isNull()).head()
        return bytes(top["digest"]) if top else None


def leaf_digest(*columns: Column) -> Column:
    """32-byte hash of a row: each value as UTF-8 byte count, ``:`` and text, ``-`` for NULL, one after another."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _hash(digests: Column) -> Column:
    """32-byte hash of an array of digests, joined as hexadecimal text."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "").cast("binary"), 256))


def build(frame: DataFrame, key: str, group: str, leaf: Column, claimed: Column | None = None) -> Manifest:
    """Hash trees over the rows of ``frame``. ``claimed`` is the leaf hash to be checked (the leaf itself by default).

    Runs actions: one pass over the rows, then one small aggregation for each level.
    """
    named = frame.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("group"),  # no NULLs, same order
        leaf.alias("leaf"),
        (leaf if claimed is None else claimed).alias("claimed"),
    )
    ranked = global_rank(stored(named), ["group", F.col("key").asc_nulls_first(), "leaf", "claimed"], "rank")
    groups = stored(ranked.groupBy("group").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias("n")))
    if row_count_up_to(groups, BROADCAST_KEYS) <= BROADCAST_KEYS:
        placed = ranked.join(F.broadcast(groups), "group")
    else:
        placed = join_on_key(ranked, groups, "group", "inner", hot_keys(ranked, "group"), "rank")
    pos = F.col("rank") - F.col("tree")
    member = F.struct((pos % FAN).cast("int").alias("slot"), "key", "leaf", "claimed")
    runs = placed.groupBy("tree", F.expr(f"(rank - tree) div {FAN}").alias("pos")).agg(
        F.ceil(F.first("n") / FAN).alias("n"), F.array_sort(F.collect_list(member)).alias("members")
    )
    alone = F.size("members") == 1
    lone = alone & (F.col("n") == 1)  # a run of one in a longer level is hashed, a lone leaf is not
    runs = stored(runs.withColumn("digest", F.when(lone, F.col("members")[0]["leaf"]).otherwise(_hash(F.col("members.leaf")))))

    levels = _levels(runs, 1)
    nodes = _union(levels, runs)
    subroots = runs.filter("n = 1").select("tree", "digest").unionByName(nodes.filter("n = 1").select("tree", "digest"))
    places = stored(global_rank(subroots, ["tree"], "place").withColumn("place", F.col("place") - 1))
    count = places.count()
    low = places.select(F.lit(TOP).cast("long").alias("tree"), F.col("place").alias("pos"), F.lit(count).cast("long").alias("n"), "digest")
    top = _union(_levels(low, 0), runs)
    return Manifest(_linked(runs.withColumn("level", F.lit(1)), places, count), stored(_linked(nodes, places, count).unionByName(_linked(top, places, count))))


def _levels(rows: DataFrame, level: int) -> list[DataFrame]:
    """The levels above ``rows`` (tree, pos, n nodes in its level, digest), each stored (actions: one per level)."""
    found = []
    while not (more := rows.filter("n > 1")).isEmpty():
        level += 1
        child = F.struct("pos", "digest")
        runs = more.groupBy("tree", F.expr(f"pos div {FAN}").alias("parent_pos")).agg(
            F.ceil(F.first("n") / FAN).alias("n"), F.array_sort(F.collect_list(child))["digest"].alias("children")
        )
        rows = stored(runs.select("tree", F.lit(level).alias("level"), F.col("parent_pos").alias("pos"), "n", "children", _hash(F.col("children")).alias("digest")))
        found.append(rows)
    return found


def _union(levels: list[DataFrame], like: DataFrame) -> DataFrame:
    whole = like.sparkSession.createDataFrame([], "tree long, level int, pos long, n long, children array<binary>, digest binary")
    for level in levels:
        whole = whole.unionByName(level)
    return whole


def _linked(nodes: DataFrame, places: DataFrame, count: int) -> DataFrame:
    """``nodes`` with their parent (tree, level, pos), NULL for the root, their slot in it, and whether they are subroots."""
    parent = lambda tree, level, pos: F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), F.expr(pos).cast("long").alias("pos"))
    inner = nodes.filter("n > 1").select(
        "*", parent(F.col("tree"), F.col("level") + 1, f"pos div {FAN}").alias("parent"), (F.col("pos") % FAN).cast("int").alias("slot"), F.lit(False).alias("is_subroot")
    )
    above = F.when(F.lit(count > 1), parent(F.lit(TOP), F.lit(1), f"place div {FAN}"))
    ends = nodes.filter(f"n = 1 AND tree <> {TOP}").join(places.select("tree", "place"), "tree")
    ends = ends.select(*[F.col(c) for c in nodes.columns], above.alias("parent"), (F.col("place") % FAN).cast("int").alias("slot"), F.lit(True).alias("is_subroot"))
    root = nodes.filter(f"n = 1 AND tree = {TOP}").select("*", F.lit(None).cast("struct<tree:bigint,level:int,pos:bigint>").alias("parent"), F.lit(0).alias("slot"), F.lit(False).alias("is_subroot"))
    return inner.unionByName(ends).unionByName(root)


_CLIMB = """
WITH RECURSIVE climb (members, tail, subroot, digest, parent, slot) AS (
  SELECT members, tail, subroot, digest, parent, slot FROM {start}
  UNION ALL
  SELECT
    transform(c.members, m -> named_struct('key', m.key, 'leaf', m.leaf, 'folded',
      unhex(sha2(CAST(array_join(transform(n.children, (x, i) -> lower(hex(if(i = c.slot, m.folded, x)))), '') AS BINARY), 256)))),
    aggregate(filter(n.children, (x, i) -> i <> c.slot), c.tail, (a, x) -> concat(a, x)),
    if(n.is_subroot, n.digest, c.subroot), n.digest, n.parent, n.slot
  FROM climb c JOIN {nodes} n ON c.parent.tree = n.tree AND c.parent.level = n.level AND c.parent.pos = n.pos
)
SELECT members, tail, subroot, digest AS root FROM climb WHERE parent IS NULL"""


def prove(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """One row per leaf: key, leaf, subroot, root (binary), ``siblings`` (all digests of the proof, 32 bytes each), folded_root.

    Runs the recursive query (an action). Its row limit, which guards against endless recursion, is lifted while it runs: a
    climb ends at the root, after as many steps as the tree has levels.
    """
    name = uuid.uuid4().hex
    members = F.col("members")
    folded = F.transform(
        members,
        lambda m, i: F.struct(
            m["key"].alias("key"),
            m["leaf"].alias("leaf"),
            F.when((F.size("members") == 1) & F.col("is_subroot"), m["claimed"])  # a lone leaf
            .otherwise(_hash(F.transform(members, lambda o, j: F.when(j == i, o["claimed"]).otherwise(o["leaf"]))))
            .alias("folded"),
        ),
    )
    start = manifest.runs.select(
        folded.alias("members"),
        F.lit("").cast("binary").alias("tail"),
        F.when(F.col("is_subroot"), F.col("digest")).alias("subroot"),
        "digest",
        "parent",
        "slot",
    )
    start.createOrReplaceTempView(f"start_{name}")
    manifest.nodes.createOrReplaceTempView(f"nodes_{name}")
    before = spark.conf.get(_ROWS, None)
    spark.conf.set(_ROWS, "-1")
    try:
        climbed = stored(spark.sql(_CLIMB.format(start=f"start_{name}", nodes=f"nodes_{name}")))
    finally:
        spark.conf.set(_ROWS, before) if before is not None else spark.conf.unset(_ROWS)
        spark.catalog.dropTempView(f"start_{name}")
        spark.catalog.dropTempView(f"nodes_{name}")
    each = climbed.select("*", F.posexplode("members").alias("i", "own"))
    near = F.aggregate(F.filter("members.leaf", lambda _, j: j != F.col("i")), F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
    return each.select("own.key", "own.leaf", "subroot", "root", F.concat(near, "tail").alias("siblings"), F.col("own.folded").alias("folded_root"))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and only those, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
