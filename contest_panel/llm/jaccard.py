"""Operator 9, n-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

Texts become sets of hashed word shingles. Equal sets are one class from the start. Then:

1. Keys. Sizes are cut into bands. Two sets that link differ in few shingles, so if hashes are dealt into more
   segments than that, some segments are equal in both sets (pigeonhole). A set sends one key per segment of
   its band, and of bands below where a smaller partner may be; sets that share a key meet. Keys are dealt by
   ranges and travel as packed arrays, five bytes each, cut to what tells them apart within a range: a key that two
   sets share by chance makes a candidate more. Keys with the same sets are one.
2. Tiles. The sets of a key are a tile. A signature is a bitmap of the parity of hash buckets: its differing
   bits are at most the differing shingles, so they bound the overlap from above. Pairs whose bound is too low,
   or whose sizes are, part here; the rest are candidates, and connected candidates form a cluster. A key with
   more than ``KEY_TILE`` sets is not compared, all its sets are candidates.
3. The sets of a cluster are compared in a tile of their own: sorted by size, signature bound again, then exact
   intersection of the sorted arrays. Pairs already connected are passed over, since the result is the component.
   A cluster over ``TILE`` sets is first compared with a few of its members; what they join into one large
   component needs no comparing among itself, so tiles pair blocks of the rest with blocks of all.

Texts are read three times and not shuffled; rows are chosen by broadcast ids, or by bits of them if they are many.
Sets and shingles are known by hashes of 64 bits.

Defined results: NULL, empty and blank texts have 0 shingles and are their own component; repeated rows and
equal texts share a component; rows with NULL id take part, and a component is named by its smallest id that
is not NULL (NULL if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from contest_panel.llm.common import map_texts, to_arrow
from contest_panel.llm.graph import BROADCAST_ROWS, components, stored
from contest_panel.llm.membership import KeyBits, leave_out
from contest_panel.llm.words import mix
from contest_panel.operators.skew import join_on_key
from contest_panel.session import parallelism

BAND_RATIO = 1.5
SIGMAS = 4
TILE = 1_024
PIVOTS = 32
KEY_TILE = 1_024
HOT_COPIES = 1_000
#: A chunk of keys has about so many keys and at most so many sets; a range of keys is met by sets of so many shingles in all.
CHUNK_KEYS, CHUNK_SETS, PART_SHINGLES = 1_500_000, 65_536, 2_000_000


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z in lower case; words are cut at blanks of ASCII."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    inside = np.arange(len(raw)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(raw)]))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        value = np.where(blank, np.uint64(0), (low.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(inside, len(powers) - 1)])
        return mix(np.add.reduceat(value, start, dtype=np.uint64) + length.astype(np.uint64))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run."""
    words = word_hashes(text)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        width = min(width, len(words))
        found = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            found = found * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - width + 1 + i]
        return np.unique(mix(found))


def node_of(found: np.ndarray) -> int:
    """Identity of a set."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(found) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        total = mix(found + place).sum(dtype=np.uint64) + np.uint64(len(found))
        return int(mix(np.array([total])).view(np.int64)[0])


@lru_cache(maxsize=None)
def segments(band: int, threshold: float) -> tuple[int, int]:
    """Segments of the band of a pair's smaller set, and how many of them are spare.

    Sets that link differ in at most (1 / threshold - 1) times the smaller one, so one segment more than that
    is equal in both, and each spare one adds another. There are as many spare ones as segments may be empty
    in nearly all sets of the band: then a segment that is equal and not empty is left.
    """
    low, high = BAND_RATIO**band, BAND_RATIO ** (band + 1)
    least = int((1 / threshold - 1) * high + 1e-6) + 1
    spare = 1
    while True:
        empty = (least + spare) * np.exp(-low / (least + spare))
        if spare >= min(least, empty + SIGMAS * np.sqrt(empty)):
            return least + spare, spare
        spare += 1


def band_of(size: float) -> int:
    return int(np.floor(np.log(max(1.0, size)) / np.log(BAND_RATIO) + 1e-9))


def tile_keys(found: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of the segments of a set, in its own band and in those below where a smaller partner may be."""
    size = len(found)
    bands = range(band_of(size * threshold - 1e-6), band_of(size) + 1)
    keys = []
    with np.errstate(over="ignore"):
        for own in bands:
            n, spare = segments(own, threshold)
            segment = ((found >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            used, first = np.unique(segment[order], return_index=True)
            content = np.add.reduceat(mix(found[order] + np.uint64(own + 1)), first, dtype=np.uint64)
            if n - len(used) > spare:
                full = np.zeros(n, np.uint64)
                full[used] = content
                used, content = np.arange(n), full
            keys.append(mix(content + used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(own * 7919 + 13)))
    return np.concatenate(keys).view(np.int64)


def signature(found: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the parity of each of ``bits`` hash buckets; the halves of a signature, xor-ed, are that of half the bits."""
    odd = np.bincount(((found >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def width_for(size: int, least: int = 256) -> int:
    return max(least, 1 << max(0, size - 1).bit_length())


def may_link(size_a: int, size_b: int, differ: int, percent: int) -> bool:
    """Whether sets of these sizes that differ in ``differ`` shingles at least can reach the similarity."""
    if min(size_a, size_b) * 100 < percent * max(size_a, size_b):
        return False
    return (100 - percent) * (size_a + size_b) >= (100 + percent) * differ


def differing(a: tuple[int, int], b: tuple[int, int]) -> int:
    """Differing bits of two signatures, each (bits, number), folded to the smaller one's bits."""
    (wide, x), (narrow, y) = (a, b) if a[0] >= b[0] else (b, a)
    while wide > narrow:
        wide //= 2
        x = (x >> wide) ^ (x & ((1 << wide) - 1))
    return (x ^ y).bit_count()


def meet(nodes: list[int], sizes: list[int], signatures: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect the sets of a key whose signatures allow a link."""
    group, parts, found = list(range(len(nodes))), len(nodes), []
    for i in range(len(nodes) - 1):
        if parts == 1:
            break
        for j in range(i + 1, len(nodes)):
            if group[i] != group[j] and may_link(sizes[i], sizes[j], differing(signatures[i], signatures[j]), percent):
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
                parts -= 1
                found.append((nodes[i], nodes[j]))
    return found


class Tile:
    """Sets of one cluster: finds enough links to connect what links, by size, signature bound and exact intersection."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.threshold = threshold
        bits = width_for(2 * int(self.sizes.max()))
        self.maps = np.stack([signature(s, bits) for s in self.sets]).view(np.uint64)

    def enough(self, overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        percent = round(self.threshold * 100)
        return (100 + percent) * overlap >= percent * sizes

    def links(self, left: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links as pairs of places in the given list; with ``left``, only pairs with a True in it."""
        group = np.arange(len(self.sets))
        side = np.ones(len(self.sets), bool) if left is None else left[self.order]
        found = []
        for i in range(len(self.sets) - 1):
            last = int(np.searchsorted(self.sizes, self.sizes[i] / self.threshold + 1e-6, side="right"))
            others = np.arange(i + 1, last)
            others = others[(group[others] != group[i]) & (side[others] | side[i])]
            if not len(others):
                continue
            differ = np.bitwise_count(self.maps[others] ^ self.maps[i]).sum(1, dtype=np.int64)
            both = self.sizes[others] + self.sizes[i]
            for j in others[self.enough((both - differ) // 2, both)]:
                if group[j] != group[i]:
                    a, b = self.sets[i], self.sets[j]
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    if self.enough(int((b[at] == a).sum()), len(a) + len(b)):
                        group[group == group[j]] = group[i]
                        found.append((self.order[i], self.order[j]))
        return found


def _tile_links(sets: DataFrame, tile: Column, threshold: float) -> DataFrame:
    """Links (a, b) found in each tile of ``sets`` (node, left, content); a tile is bounded by its maker."""

    def close(rows: dict[int, tuple[bool, bytes]]) -> tuple[list[int], list[int]]:
        nodes = list(rows)
        if len(nodes) < 2:
            return [], []
        work = Tile([np.frombuffer(rows[n][1], np.uint64) for n in nodes], threshold)
        pairs = work.links(np.array([rows[n][0] for n in nodes]))
        return [nodes[i] for i, _ in pairs], [nodes[j] for _, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            a, b = [], []
            for tile, node, left, content in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != now:
                    for into, more in zip((a, b), close(rows)):
                        into += more
                    now, rows = tile, {}
                rows[node] = (left or rows.get(node, (False,))[0], content)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        a, b = close(rows)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tiled = sets.select(tile.alias("tile"), "node", "left", "content")
    return tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


class KeyChunk:
    """Keys of the sets of a part of a task, as rows for the shuffle: one for each of ``parts`` ranges of keys.

    In a row, keys are four bytes each, in order and by planes of bytes, which compress well; the set of each key is
    its number in the chunk, in two bytes. A last row has the nodes of the numbers.
    """

    def __init__(self, parts: int):
        self.parts, self.nodes, self.keys, self.sets, self.size = parts, [], [], [], 0

    def add(self, node: int, keys: np.ndarray) -> None:
        self.keys.append(keys.view(np.uint64))
        self.sets.append(np.full(len(keys), len(self.nodes), np.uint16))
        self.nodes.append(node)
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= CHUNK_KEYS or len(self.nodes) == CHUNK_SETS

    def rows(self) -> dict:
        keys, sets = np.concatenate(self.keys), np.concatenate(self.sets)
        keys = ((keys >> np.uint64(32)) % np.uint64(self.parts) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        order = np.argsort(keys)
        keys, sets = keys[order], sets[order]
        used, first = np.unique(keys >> np.uint64(32), return_index=True)
        low = keys.astype(np.uint32)
        ends = [*first[1:].tolist(), len(low)]
        planes = [low[i:j].view(np.uint8).reshape(-1, 4).T.tobytes() for i, j in zip(first.tolist(), ends)]
        nodes = np.array(self.nodes, np.int64)
        chunk = node_of(nodes.view(np.uint64))
        return {
            "part": [*used.astype(int).tolist(), self.parts + chunk % self.parts],
            "chunk": [chunk] * (len(used) + 1),
            "keys": [*planes, nodes.tobytes()],
            "sets": [*(sets[i:j].tobytes() for i, j in zip(first.tolist(), ends)), b""],
        }


def shared_keys(rows: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of sets that share a key, from the rows (chunk, keys, sets) of a range: group, chunk and number of each set.

    Groups of the same sets are one, whatever their keys.
    """
    own = np.array([chunk for chunk, _, _ in rows], np.int64)
    low = np.concatenate([np.frombuffer(k, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for _, k, _ in rows])
    number = np.concatenate([np.frombuffer(s, np.uint16) for _, _, s in rows])
    chunk = np.repeat(np.arange(len(rows)), [len(s) // 2 for _, _, s in rows])
    order = np.argsort(low, kind="stable")
    low = low[order]
    same = low[1:] == low[:-1]
    met = np.r_[False, same] | np.r_[same, False]
    first = np.flatnonzero(met & ~np.r_[False, same])
    order = order[met]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    size = np.diff(np.r_[np.cumsum(met)[first] - 1, len(order)])
    chunk, number = own[chunk[order]], number[order]
    with np.errstate(over="ignore"):
        name = mix(mix(chunk.view(np.uint64)) + number.astype(np.uint64))
        group = mix(np.add.reduceat(name, np.cumsum(size) - size, dtype=np.uint64) + size.astype(np.uint64)).view(np.int64)
    chosen = np.zeros(len(group), bool)
    chosen[np.unique(group, return_index=True)[1]] = True
    chosen = np.repeat(chosen, size)
    return np.repeat(group, size)[chosen], chunk[chosen], number[chosen].astype(np.int32)


def _shared(frame: DataFrame, width: int, threshold: float, parts: int) -> DataFrame:
    """Groups of sets that share a key: (k, node). Runs an action."""

    def keyed(slices: Iterator) -> Iterator[dict]:
        sent: set[int] = set()  # equal sets of one task send their keys once
        chunk = KeyChunk(parts)
        for _, texts in slices:
            for t in texts:
                found = shingles(t, width)
                if len(found) and (node := node_of(found)) not in sent:
                    chunk.add(node, tile_keys(found, threshold))
                    if len(sent) < 1_000_000:
                        sent.add(node)
                    if chunk.full():
                        yield chunk.rows()
                        chunk = KeyChunk(parts)
        if chunk.size:
            yield chunk.rows()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for part, chunk, keys, sets in zip(*(c.to_pylist() for c in batch.columns)):
                if part >= parts:
                    nodes = np.frombuffer(keys, np.int64)
                    yield out(None, np.full(len(nodes), chunk), np.arange(len(nodes), dtype=np.int32), nodes)
                    continue
                if part != now:
                    if len(rows) > 0:
                        yield out(*shared_keys(rows))
                    now, rows = part, []
                rows.append((chunk, keys, sets))
        if rows:
            yield out(*shared_keys(rows))

    def out(k: np.ndarray | None, chunk: np.ndarray, number: np.ndarray, node: np.ndarray | None = None) -> pa.RecordBatch:
        own = {"k": k, "chunk": chunk, "number": number, "node": node}
        return pa.RecordBatch.from_arrays([pa.nulls(len(chunk), f.type) if own[f.name] is None else pa.array(own[f.name], f.type) for f in wanted], schema=wanted)

    schema = "k long, chunk long, number int, node long"
    wanted = to_arrow(schema)
    keys = map_texts(frame, {}, "text", "part int, chunk long, keys binary, sets binary", keyed)
    every = stored(keys.repartition("part").sortWithinPartitions("part").mapInArrow(met, schema))
    nodes = every.filter("k is null").select("chunk", "number", "node").distinct()
    return every.filter("k is not null").select("k", "chunk", "number").distinct().join(nodes, ["chunk", "number"]).select("k", "node").distinct()


def _meetings(frame: DataFrame, width: int, threshold: float, classes: DataFrame, key_tile: int) -> DataFrame:
    """Candidate links (a, b) that connect the sets of each key whose signatures allow a link. Runs actions."""
    percent = round(threshold * 100)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sizes, signatures, star = None, [], [], [], False
        for batch in batches:
            found = []
            for k, node, n, bitmap in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    if not star and len(nodes) > 1:
                        found += meet(nodes, sizes, signatures, percent)
                    now, nodes, sizes, signatures, star = k, [], [], [], False
                if not star:
                    if nodes and nodes[-1] == node:
                        continue
                    nodes.append(node)
                    sizes.append(n)
                    signatures.append((len(bitmap) * 8, int.from_bytes(bitmap, "little")))
                    if len(nodes) > key_tile:
                        found += [(nodes[0], other) for other in nodes[1:]]
                        star, nodes = True, nodes[:1]
                elif node != nodes[0]:
                    found.append((nodes[0], node))
            yield pairs(found)
        yield pairs([] if star or len(nodes) < 2 else meet(nodes, sizes, signatures, percent))

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # One row of each class sends keys; of the others a few do by chance, and every row of a repeated id.
    count, rows, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    if rows > count:
        frame = KeyBits(classes, "key", count).within(frame, "key")
    shared = _shared(frame, width, threshold, max(4 * parallelism(frame.sparkSession), -(-total // PART_SHINGLES)))
    signed = shared.join(classes.select("node", "n", "bitmap"), "node").select("k", "node", "n", "bitmap")
    return signed.repartition("k").sortWithinPartitions("k", "node").mapInArrow(tiles, "a long, b long")


def join_components(
    frame: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 3,
    threshold: float = 0.9,
    tile: int = TILE,
    key_tile: int = KEY_TILE,
) -> DataFrame:
    """One row per row of ``frame``: key, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Two sets link when their Jaccard similarity is ``threshold`` (whole percents) or more. Runs actions.
    """
    kind = frame.schema[key].dataType.simpleString()
    frame = frame.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def first(slices: Iterator) -> Iterator[dict]:
        for batch, texts in slices:
            found = [shingles(t, width) for t in texts]
            yield {
                "key": batch.column(0),
                "n": [len(f) for f in found],
                "node": [node_of(f) if len(f) else None for f in found],
                "bitmap": [signature(f, width_for(len(f))).tobytes() if len(f) else None for f in found],
            }

    every = stored(map_texts(frame, {"key": "key"}, "text", f"key {kind}, n long, node long, bitmap binary", first))
    classes = stored(
        every.filter(F.col("node").isNotNull()).groupBy("node").agg(
            F.min("key").alias("key"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("copies")
        )
    )
    clusters = stored(components(_meetings(frame, width, threshold, classes, key_tile)))
    labels = components(_links(frame, width, threshold, tile, clusters, classes))
    named = labels.join(classes.select("node", "key"), "node")
    ends = named.groupBy("label").agg(F.min("key").alias("component"))
    # Rows of classes of their own keep their id; the others look up their component.
    linked = named.join(ends, "label").select("node", "component")
    by_node = classes.join(linked, "node", "left").select("node", F.coalesce("component", "key").alias("component_id"))
    hot = classes.filter(F.col("copies") >= HOT_COPIES).select("node")  # a row for every HOT_COPIES rows at most
    found = hot.count()
    hot = (F.broadcast(hot) if found <= BROADCAST_ROWS else hot) if found else None
    result = join_on_key(every.select("key", "n", "node"), by_node, "node", "left", hot, "key")
    own = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return result.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _links(
    frame: DataFrame, width: int, threshold: float, tile: int, clusters: DataFrame, classes: DataFrame
) -> DataFrame:
    """Links (a, b) between nodes that connect what links inside the clusters."""

    def second(slices: Iterator) -> Iterator[dict]:
        for batch, texts in slices:
            nodes, contents = [], []
            for t in texts:
                found = shingles(t, width)
                nodes.append(node_of(found) if len(found) else None)
                contents.append(found.tobytes())
            yield {"node": nodes, "content": contents}

    frame = frame.alias("frame")
    count = clusters.count()
    few = count <= BROADCAST_ROWS
    wide = F.broadcast if few else lambda f: f
    wanted = classes.join(clusters, "node").select(F.col("key").alias("wanted"))
    if few:
        chosen = frame.join(F.broadcast(wanted), F.col("frame.key").eqNullSafe(F.col("wanted")), "left_semi")
    else:  # what passes by chance is left out by its node
        chosen = KeyBits(wanted, "wanted", count).within(frame, "key")
    sets = map_texts(chosen, {}, "text", "node long, content binary", second).join(wide(clusters), "node")
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.filter(F.col("members") > tile)
    found = large.count()
    if not found:
        return _tile_links(sets.withColumn("left", F.lit(True)), F.col("label"), threshold)

    # At most one row for every ``tile`` sets: broadcast, so that no large cluster is one task's join key.
    each_cluster = F.broadcast if found <= BROADCAST_ROWS else lambda f: f
    sets = stored(sets.join(each_cluster(large), "label", "left"))
    plain = _tile_links(sets.filter("members is null").withColumn("left", F.lit(True)), F.col("label"), threshold)
    big = sets.filter("members is not null").dropDuplicates(["node"])
    blocks = F.ceil(F.col("members") / tile)
    of = F.pmod(F.xxhash64("node"), blocks)
    rank = Window.partitionBy("label").orderBy(F.xxhash64("node", F.lit(1)), "node")
    pivots = big.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= PIVOTS)
    each = pivots.select(F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "label", "node", "content")
    around = big.select(of.alias("block"), "label", "node", "content").withColumn("left", F.lit(False))
    near = stored(_tile_links(around.unionByName(each.withColumn("left", F.lit(True))), F.xxhash64("label", "block"), threshold))

    joined = components(near).withColumnRenamed("label", "part")
    parts = big.select("label", "node").join(joined, "node", "left").withColumn("part", F.coalesce("part", "node"))
    main = parts.groupBy("label", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("label").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    rest = parts.join(each_cluster(main), "label").filter(F.col("part") != F.col("main")).select("node", F.lit(True).alias("left"))
    rest = stored(big.join(rest, "node", "left").withColumn("left", F.coalesce("left", F.lit(False))))
    counts = rest.groupBy("label").agg(F.ceil(F.count_if("left") / tile).alias("rows"))
    spread = rest.join(each_cluster(counts), "label").filter("rows > 0")
    row = F.pmod(F.xxhash64("node"), F.col("rows"))
    column = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / tile))
    # A member of the rest is a row of tiles, one tile for each block of all; everyone is in one block of each row.
    lefts = spread.filter("left").select(
        row.alias("row"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / tile) - 1)).alias("column"), "label", "node", "left", "content"
    )
    alls = spread.select(F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), column.alias("column"), "label", "node", F.lit(False).alias("left"), "content")
    cross = _tile_links(lefts.unionByName(alls), F.xxhash64("label", "row", "column"), threshold)
    return plain.unionByName(near).unionByName(cross)


def keep_one(frame: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``frame`` without near duplicates: of each component the row with the smallest id stays. Runs actions.

    Ids that are NULL come last. Rows of equal id are told apart by their text; of rows equal in both one stays.
    Texts without words are no duplicates of each other.
    """
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    name = "__key"
    while name in frame.columns:
        name += "_"
    keyed = frame.withColumn(name, own)
    found = stored(join_components(keyed, name, text, width, threshold))
    copy = F.coalesce(F.col(name) != F.col("component_id"), F.lit(False))
    kept = leave_out(keyed, name, found.filter(copy).select(name).distinct(), found.filter(~copy), BROADCAST_ROWS)
    repeated = found.filter(F.col(name) == F.col("component_id")).groupBy(name).count().filter("count > 1").select(name)
    if again := repeated.count():
        bits = KeyBits(repeated, name, again)
        kept = bits.without(kept, name).unionByName(bits.within(kept, name).dropDuplicates([name]))
    return kept.select(*[f"`{c}`" for c in frame.columns])
