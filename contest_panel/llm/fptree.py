"""Operator 11, ranked lexical search: the best documents for each item, by branch and bound over document FP-trees.

A first pass counts the items' terms in every whole text (the restricted vectors, written as a table) and all terms by number
only. Document frequencies, the number of documents and of terms are sums over that table. Terms are ranked by falling
frequency, and a second pass cuts the vectors into shards and builds a trie from each: vectors in frequency order share the
paths of their frequent terms. A node ends where fewer than ``LEAF`` documents are left, which then hang below it. Every
node knows its subtree's largest count of each term and its smallest m, so

    sum over the item's terms of w * (10^9 tf) div (1000 tf + 12 m)   with these extremes

bounds the score of every document below, and is the score itself for a single document. Each item's search goes depth
first, the child of highest bound first, and leaves out children whose bound is under the k-th score found so far in this
task. Scores are whole numbers, so sums in any order are equal. The best k of all tasks are ranked per item at the end.

Items come to the tasks in blocks of about ``BLOCK_BYTES`` of terms (one block unless items are very many), each broadcast
and searched over all documents. A task holds one shard of at most about ``SHARD_ENTRIES`` counts.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower case, compared as bytes.
Defined results: NULL and empty texts have no terms, find nothing and are not found; they count neither in the number of
documents nor of terms; repeated rows of documents are documents of their own; rows of equal item id are one item of all
their terms; NULL ids of documents come last among equal scores, a NULL item id is an item; items without a known term
have no rows; very long texts are counted in pieces. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from contest_panel.llm.common import map_texts, to_arrow
from contest_panel.llm.graph import stored

LEAF = 32
SHARD_ENTRIES = 1_500_000
BLOCK_BYTES = 8_000_000
_PIECE = 1_000_000
_ANY = 1 << 62
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def term_counts(text: str) -> Counter[bytes]:
    """How often each term occurs in a text."""
    raw = text.encode("utf-8", "surrogatepass").translate(_SPACED)
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def weight(n: int, df: int) -> int:
    """Whole weight of a term in ``df`` of ``n`` documents."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a unit of weight counts for: grows with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _vectors(frame: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """key, n terms, and the counts of the terms in ``vocabulary``."""
    kind = frame.schema[key].dataType.simpleString()
    known = frame.sparkSession.sparkContext.broadcast(vocabulary)

    def work(slices: Iterator) -> Iterator[dict]:
        number = known.value
        for batch, texts in slices:
            sizes, totals, terms, counts = [0], [], [], []
            for own in texts:
                found = term_counts(own)
                shared = found.keys() & number.keys()
                terms += [number[t] for t in shared]
                counts += [found[t] for t in shared]
                sizes.append(len(terms))
                totals.append(found.total())
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32())) for values in (terms, counts)]
            yield {"key": batch.column(0), "n": totals, "term": lists[0], "tf": lists[1]}

    return map_texts(frame, {"key": key}, text, f"key {kind}, n long, term array<int>, tf array<int>", work)


class Trie:
    """A document FP-tree. Nodes are numbered by depth, so the children of a node are consecutive; documents are its leaves.

    ``size``, ``rank`` and ``tf`` are the documents' counts one after another, ranks ascending in each; ``m`` is by document.
    """

    def __init__(self, size: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        first = np.r_[0, np.cumsum(size)]
        raw = (rank + 1).astype(">u4").tobytes()
        paths = [raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        level, self.doc, self.children = self._grow(order, [paths[i] for i in order], first, size, rank, leaf)
        nodes = self.nodes = len(level)
        self.m = np.zeros(nodes, np.int64)
        at_leaf = np.flatnonzero(self.doc >= 0)
        self.m[at_leaf] = m[self.doc[at_leaf]]
        parent = np.zeros(nodes, np.int64)
        for node in sorted(self.children, reverse=True):
            low, high = self.children[node]
            self.m[node] = self.m[low:high].min()
            parent[low:high] = node
        # Counts of the leaves, then the largest of each parent's children, level by level from the lowest.
        home = np.zeros(len(size), np.int64)
        home[self.doc[at_leaf]] = at_leaf
        own = np.repeat(home, size)
        keys, most = [rank.astype(np.int64) * nodes + own], [tf.astype(np.int64)]
        deep = level[own]
        pending: tuple[np.ndarray, np.ndarray] | None = None
        for depth in range(int(level.max(initial=0)), 1, -1):
            here = deep == depth
            below, high = keys[0][here], most[0][here]
            if pending is not None:
                below, high = np.concatenate([below, pending[0]]), np.concatenate([high, pending[1]])
            term, node = np.divmod(below, nodes)
            up = term * nodes + parent[node]
            by = np.argsort(up, kind="stable")
            up, high = up[by], high[by]
            start = np.flatnonzero(np.r_[True, up[1:] != up[:-1]]) if len(up) else np.zeros(0, int)
            pending = up[start], np.maximum.reduceat(high, start) if len(start) else high
            keys.append(pending[0])
            most.append(pending[1])
        key = np.concatenate(keys)
        by = np.argsort(key, kind="stable")
        self.key, self.most = key[by], np.concatenate(most)[by]

    @staticmethod
    def _grow(order, paths, first, size, rank, leaf) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
        """Levels of nodes, their documents (-1 for inner ones) and the inner ones' children."""
        level, doc, children = [0], [-1], {}
        queue = [(0, 0, len(order))]
        for node, low, high in queue:  # grows while it is read
            start = len(level)
            ends = list(range(low, high))
            if high - low > leaf:
                a, b = paths[low], paths[high - 1]
                depth = _shared(a, b) // 4
                inside = order[low:high]
                going = size[inside] > depth  # those that end here come first and are equal
                ended = low + int((~going).sum())
                following = rank[first[order[ended:high]] + depth]
                cuts = np.r_[0, np.flatnonzero(np.diff(following)) + 1, len(following)] + ended
                ends = list(range(low, ended))
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if y - x <= leaf // 8:
                        ends += range(x, y)
                    elif y > x:
                        queue.append((len(level), x, y))
                        level.append(level[node] + 1)
                        doc.append(-1)
            level += [level[node] + 1] * len(ends)
            doc += order[ends].tolist()
            children[node] = (start, len(level))
        return np.array(level), np.array(doc), children

    def search(self, rank: np.ndarray, weights: np.ndarray, k: int, floor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and scores that may be among the best ``k``; send back the k-th score so far (0 if there are fewer)."""
        base = rank.astype(np.int64) * self.nodes
        stack = [(_ANY, 0)]  # the root is always opened
        while stack:
            bound, node = stack.pop()
            if bound < floor:
                continue
            low, high = self.children[node]
            start, stop = np.searchsorted(self.key, base + low), np.searchsorted(self.key, base + high)
            length = stop - start
            total = int(length.sum())
            if not total:
                continue
            at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)
            child = self.key[at] - np.repeat(base, length)
            value = np.repeat(weights, length) * parts(self.most[at], self.m[child])
            score = _sums(child - low, value, high - low)
            good = np.flatnonzero(score >= max(floor, 1))
            docs = self.doc[low + good]
            leaves = docs >= 0
            if leaves.any():
                docs, scores = docs[leaves], score[good[leaves]]
                if len(docs) > k:
                    near = scores >= np.partition(scores, -k)[-k]
                    docs, scores = docs[near], scores[near]
                floor = yield docs, scores
            inner = good[~leaves]
            stack += sorted(zip(score[inner].tolist(), (low + inner).tolist()))


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else n


def _sums(index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole values by index; large ones are added in two halves, as bincount counts in doubles."""
    if float(value.sum(dtype=np.float64)) < 2**52:
        return np.bincount(index, weights=value, minlength=n).astype(np.int64)
    high, low = np.divmod(value, 1 << 26)
    return (np.bincount(index, weights=high, minlength=n).astype(np.int64) << 26) + np.bincount(index, weights=low, minlength=n).astype(np.int64)


def _order(hit: tuple[int, object]) -> tuple:
    return -hit[0], hit[1] is None, hit[1]


def _found(vectors: DataFrame, items: list[tuple], ranks: np.ndarray, n: int, total: int, k: int, item_kind: str, shard_entries: int, leaf: int) -> DataFrame:
    """Each task's best ``k`` documents of every item: item, score, doc."""
    kind = vectors.schema["key"].dataType.simpleString()
    schema = f"item {item_kind}, score long, doc {kind}"
    wanted = to_arrow(schema)
    shipped = vectors.sparkSession.sparkContext.broadcast((items, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rank_of = shipped.value
        best: list[list[tuple[int, object]]] = [[] for _ in asked]
        held, entries = [], 0

        def close() -> None:
            nonlocal held, entries
            keys = [key for part in held for key in part[0]]
            length, size, rank, tf = (np.concatenate([part[i] for part in held]) for i in range(1, 5))
            held, entries = [], 0
            doc = np.repeat(np.arange(len(size)), size)
            by = np.argsort(doc * len(rank_of) + rank, kind="stable")
            m = 100 - 25 + 25 * length * n // total
            trie = Trie(size, rank[by], tf[by], m, leaf)
            for number, (_, terms, weights) in enumerate(asked):
                own = best[number]
                search = trie.search(terms, weights, k, own[-1][0] if len(own) == k else 0)
                hit = next(search, None)
                while hit is not None:
                    own = sorted([*own, *zip(hit[1].tolist(), (keys[d] for d in hit[0]))], key=_order)[:k]
                    try:
                        hit = search.send(own[-1][0] if len(own) == k else 0)
                    except StopIteration:
                        hit = None
                best[number] = own

        for batch in batches:
            first, done = 0, np.diff(batch.column(2).offsets.to_numpy())
            while first < batch.num_rows:
                room = max(1, int(np.searchsorted(np.cumsum(done[first:]), shard_entries - entries, side="right")))
                part = batch.slice(first, room)
                size = done[first : first + room]
                rank = rank_of[part.column(2).flatten().to_numpy()]
                held.append((part.column(0).to_pylist(), part.column(1).to_numpy(), size.astype(np.int64), rank, part.column(3).flatten().to_numpy()))
                entries += int(size.sum())
                first += room
                if entries >= shard_entries or first < batch.num_rows:
                    close()
        if held:
            close()
        hits = [(item[0], score, key) for item, own in zip(asked, best) for score, key in own]
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], f.type) for i, f in enumerate(wanted)], schema=wanted)

    return vectors.filter(F.size("term") > 0).mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = 20,
    block_bytes: int = BLOCK_BYTES,
    shard_entries: int = SHARD_ENTRIES,
    leaf: int = LEAF,
) -> DataFrame:
    """The best ``k`` rows of ``docs`` with a score above 0 for each item: item, rank, key, score. Runs actions."""
    spark = docs.sparkSession
    item_kind = items.schema[item].dataType.simpleString()

    def terms_of(slices: Iterator) -> Iterator[dict]:
        for batch, texts in slices:
            for own, t in zip(batch.column(0).to_pylist(), texts):
                found = term_counts(t)
                yield {"item": [own] * len(found), "term": list(found), "n": list(found.values())}

    each = map_texts(items, {"item": item}, item_text, f"item {item_kind}, term binary, n long", terms_of)
    asked = stored(each.groupBy("item", "term").agg(F.sum("n").alias("n")))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).head()[0]
    blocks = -(-size // block_bytes)
    every = [spark.createDataFrame([], f"item {item_kind}, score long, doc {docs.schema[key].dataType.simpleString()}")]
    for number in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).toArrow().to_pylist()
        vocabulary = {term: i for i, term in enumerate(sorted({bytes(row["term"]) for row in own}))}
        if not vocabulary:
            continue
        vectors = stored(_vectors(docs, key, text, vocabulary))
        n, total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()
        if not total:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, count in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            df[term] = count
        by_frequency = np.argsort(-df, kind="stable")
        ranks = np.empty(len(df), np.int64)
        ranks[by_frequency] = np.arange(len(df))
        queries: dict[object, list[tuple[int, int]]] = {}
        for row in own:
            at = vocabulary[bytes(row["term"])]
            if df[at]:
                queries.setdefault(row["item"], []).append((int(ranks[at]), row["n"] * weight(n, int(df[at]))))
        listed = [(name, *np.array(sorted(terms), np.int64).T) for name, terms in queries.items()]
        every.append(stored(_found(vectors, listed, ranks, n, total, k, item_kind, shard_entries, leaf)))
    whole = every[0]
    for part in every[1:]:
        whole = whole.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    ranked = whole.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
