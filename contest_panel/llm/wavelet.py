"""Operator 6, token ids in binary shards: one wavelet matrix per shard.

Documents are range-partitioned and sorted by id, encoded, and written as shards: the ids of consecutive
documents as bit-planes, highest bit first, each plane in the order that the planes above sort the tokens
into. With the ones counted up to every 64-bit word, a plane answers rank (ones before a place) and select
(place of the k-th one), so a shard gives any token, the count of a token in a range, and its k-th occurrence,
without being unpacked. Planes are compressed with zstandard; counts are made when a shard is opened.

A shard is the value of one row of a Parquet table, so that Spark commits, places and reads it like any other
data, on any file system, and a lost task writes its shards again. File format of a shard, little-endian:
``b"WMX1"``; uint32 planes; uint64 tokens; uint64 bytes of the document table, which follows (an Arrow stream of
``key`` and ``n``); then for each plane uint64 number of zeros, uint64 bytes and the zstandard frame of its packed
bits. A shard ends with the document that reaches ``SHARD_TOKENS``.

Defined results: NULL and empty texts are the end id alone; NULL ids come first; rows of equal id are ordered
by text; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from contest_panel.llm.common import slices_of, to_arrow
from contest_panel.llm.graph import stored
from contest_panel.llm.tokens import ENCODE_CHARS, token_file, word_encoder
from contest_panel.session import parallelism, ship

SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sIQQ")
_PLANE = struct.Struct("<QQ")


def build(ids: np.ndarray, planes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(zeros, packed bits) of each plane of the wavelet matrix of ``ids``."""
    values = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for plane in range(planes - 1, -1, -1):
        ones = (values & values.dtype.type(1 << plane)) != 0
        low = np.compress(~ones, values)
        yield len(low), np.packbits(ones, bitorder="little")
        values = np.concatenate([low, np.compress(ones, values)])


def pack_shard(keys: pa.Array, counts: np.ndarray, ids: np.ndarray, planes: int) -> bytes:
    table = pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], ["key", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    documents = sink.getvalue().to_pybytes()
    press = zstandard.ZstdCompressor(level=1)
    parts = [_HEAD.pack(b"WMX1", planes, len(ids), len(documents)), documents]
    for zeros, bits in build(ids, planes):
        frame = press.compress(bits.tobytes())
        parts += [_PLANE.pack(zeros, len(frame)), frame]
    return b"".join(parts)


class Shard:
    """A shard opened for reading."""

    def __init__(self, blob: bytes):
        magic, planes, self.tokens, size = _HEAD.unpack_from(blob)
        if magic != b"WMX1":
            raise ValueError("not a token shard")
        at = _HEAD.size
        table = pa.ipc.open_stream(pa.py_buffer(blob)[at : at + size]).read_next_batch()
        self.keys, self.counts = table.column(0), table.column(1).to_numpy()
        at += size
        self.zeros, self.words, self._before = [], [], [None] * planes
        unpack = zstandard.ZstdDecompressor()
        for _ in range(planes):
            zeros, size = _PLANE.unpack_from(blob, at)
            at += _PLANE.size
            raw = unpack.decompress(blob[at : at + size])
            at += size
            self.zeros.append(zeros)
            self.words.append(np.frombuffer(raw + bytes(8 + -len(raw) % 8), "<u8"))

    def before(self, plane: int) -> np.ndarray:
        """Ones before each word of a plane."""
        if self._before[plane] is None:
            self._before[plane] = np.r_[0, np.cumsum(np.bitwise_count(self.words[plane]), dtype=np.int64)]
        return self._before[plane]

    def rank(self, plane: int, place: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before(plane)[word] + np.bitwise_count(self.words[plane][word] & mask)

    def select(self, plane: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of a plane."""
        before = self.before(plane)
        if not one:
            before = np.arange(len(before)) * 64 - before
        word = np.searchsorted(before, k, side="right") - 1
        bits = np.unpackbits(self.words[plane][word].reshape(-1, 1).view(np.uint8), axis=1, bitorder="little") == one
        inside = np.cumsum(bits, axis=1) == (k - before[word] + 1)[:, None]
        return word * 64 + (inside & bits).argmax(axis=1)

    def access(self, place: np.ndarray) -> np.ndarray:
        """Tokens at places."""
        place = np.asarray(place, np.int64).copy()
        token = np.zeros(len(place), np.int64)
        for plane, zeros in enumerate(self.zeros):
            one = (self.words[plane][place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self.rank(plane, place)
            token = token * 2 + one
            place = np.where(one, zeros + ones, place - ones)
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        edge = np.array([start, end], np.int64)
        for plane, zeros in enumerate(self.zeros):
            ones = self.rank(plane, edge)
            edge = zeros + ones if token >> (len(self.zeros) - 1 - plane) & 1 else edge - ones
        return int(edge[0]), int(edge[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token among the places from ``start`` to before ``end``."""
        if token < 0 or token >> len(self.zeros):
            return 0
        a, b = self._range(token, start, self.tokens if end is None else end)
        return b - a

    def locate(self, token: int) -> np.ndarray:
        """All places of a token, ascending."""
        if token < 0 or token >> len(self.zeros):
            return np.zeros(0, np.int64)
        place = np.arange(*self._range(token, 0, self.tokens))
        for plane in range(len(self.zeros) - 1, -1, -1):
            one = bool(token >> (len(self.zeros) - 1 - plane) & 1)
            place = self.select(plane, one, place - self.zeros[plane] if one else place)
        return place

    def ids(self) -> np.ndarray:
        """All tokens in order: each plane deals the tokens below it back to where they came from."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        values = np.zeros(self.tokens, kind)
        for plane in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.words[plane].view(np.uint8), count=self.tokens, bitorder="little").view(bool)
            out = np.empty(self.tokens, kind)
            zeros = self.zeros[plane]
            out[np.flatnonzero(~one)] = values[:zeros]
            out[np.flatnonzero(one)] = values[zeros:] | kind(1 << (len(self.zeros) - 1 - plane))
            values = out
        return values


def write_shards(
    frame: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 1, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encode every row and write shards in ascending order of ``key``; returns the table of shards (an action).

    Columns: ``part`` and ``number`` (the order of shards), ``n_docs``, ``n_tokens``, ``shard``.
    """
    path = path or token_file("word_bpe_49k.json")
    ship(frame.sparkSession)
    kind = frame.schema[key].dataType.simpleString()
    wanted = to_arrow("part int, number int, n_docs long, n_tokens long, shard binary")
    key_type = to_arrow(f"key {kind}").field(0).type

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        planes = max(1, max(end, encoder.tokenizer.get_vocab_size() - 1).bit_length())
        part, number = TaskContext.get().partitionId(), 0
        keys, counts, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, counts, ids, held, number
            table = pa.concat_arrays(keys)
            blob = pack_shard(table, np.concatenate(counts), np.concatenate(ids), planes)
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "n_docs": [len(table)], "n_tokens": [held], "shard": [blob]}, schema=wanted)
            keys, counts, ids, held, number = [], [], [], 0, number + 1
            return row

        for batch, texts in slices_of(batches, "text", ENCODE_CHARS):
            found, bounds = encoder.encode(pc.fill_null(texts, ""))
            length = np.diff(bounds) + 1
            ends = np.cumsum(length)
            whole = np.insert(found, bounds[1:], end)
            first = 0
            while first < len(length):
                start = ends[first - 1] if first else 0
                last = min(len(length), int(np.searchsorted(ends, start + shard_tokens - held)) + 1)
                keys.append(batch.column(0).slice(first, last - first).cast(key_type))
                counts.append(length[first:last])
                ids.append(whole[start : ends[last - 1]])
                held += int(ends[last - 1] - start)
                first = last
                if held >= shard_tokens:
                    yield close()
        if keys:
            yield close()

    ordered = (
        frame.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
        .repartitionByRange(parallelism(frame.sparkSession), "key")
        .sortWithinPartitions("key", "text")
    )
    return stored(ordered.mapInArrow(write, "part int, number int, n_docs long, n_tokens long, shard binary"))


def read_documents(shards: DataFrame, key: str, kind: str) -> DataFrame:
    """One row per document, from the shards: key, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32``."""
    schema = f"part int, number int, key {kind}, inside long, n_tokens long, ids_crc32 long"
    wanted = to_arrow(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns))):
                shard = Shard(blob.as_py())
                ids, ends = shard.ids().astype("<u4"), np.cumsum(shard.counts)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), shard.counts.tolist())]
                n = len(ends)
                columns = [[part] * n, [number] * n, shard.keys, ends - shard.counts, shard.counts, crc]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, wanted)], schema=wanted)

    rows = shards.select("part", "number", "shard").mapInArrow(read, schema)
    # One row per part, then one per shard of a part: no task sees all shards.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("number")
    offsets = shards.select("part", "number", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("before")).join(parts, "part")
    start = F.col("before_part") + F.col("before") + F.col("inside")
    return rows.join(offsets, ["part", "number"]).select(F.col("key").alias(key), start.alias("start"), "n_tokens", "ids_crc32")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Count of a token in every shard (part, number, n), by rank alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [Shard(blob.as_py()).count(token) for blob in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["part", "number", "n"])

    return shards.select("part", "number", "shard").mapInArrow(count, "part int, number int, n long")
