"""Rows whose key is one of many, found without a shuffle of the rows.

Keys too many to broadcast become a table of bits, two bytes for each: a Bloom filter in blocks, one row per block.
The table is broadcast and every row looks up its block, so only keys are shuffled, while the table is made.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

#: Bits for each key, bits that a key sets, and bits of a block: about one other key in 400 passes.
KEY_BITS, HASHES, BLOCK_BITS = 16, 4, 4096


class KeyBits:
    """Bits of the distinct values of ``key`` in ``keys``, about ``count`` of them."""

    def __init__(self, keys: DataFrame, key: str, count: int):
        self.blocks = max(1, -(-count * KEY_BITS // BLOCK_BITS))
        places = keys.select(self._block(key).alias("block"), F.explode(F.array(*self._places(key))).alias("place"))
        word = F.shiftright("place", 6).cast("int")
        bits = places.groupBy("block", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        of_block = bits.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
        words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.element_at("bits", i), F.lit(0).cast("long")))
        self.table = of_block.select(F.col("block").alias("__block"), words.alias("__words"))

    def _block(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")

    def _places(self, key: str) -> list[Column]:
        own = F.xxhash64(key, F.lit(1))
        return [F.shiftrightunsigned(own, 12 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(HASHES)]

    def _passes(self, key: str) -> Column:
        word = lambda p: F.get("__words", F.shiftright(p, 6).cast("int"))
        return reduce(and_, [F.getbit(word(p), p.bitwiseAND(63).cast("int")) == 1 for p in self._places(key)], self._block(key) == F.col("__block"))

    def within(self, frame: DataFrame, key: str) -> DataFrame:
        """Rows of ``frame`` whose ``key`` is among the keys, and a few others."""
        return frame.join(F.broadcast(self.table), self._passes(key), "left_semi")

    def without(self, frame: DataFrame, key: str, unless: str | None = None) -> DataFrame:
        """Rows of ``frame`` that ``within`` leaves out, and those where the column ``unless`` is true."""
        passes = self._passes(key)
        return frame.join(F.broadcast(self.table), passes if unless is None else passes & F.col(unless).isNull(), "left_anti")


def leave_out(frame: DataFrame, key: str, gone: DataFrame, stay: DataFrame, limit: int) -> DataFrame:
    """Rows of ``frame`` whose ``key`` is not in ``gone``; the keys of ``frame`` are those in ``gone`` or ``stay``. Runs actions.

    Up to ``limit`` keys of ``gone`` are broadcast. Beyond, bits of them are, and the keys of ``stay`` that pass
    them by chance, one in 400, are broadcast in their turn.
    """
    count = gone.count()
    if count <= limit:
        return frame.join(F.broadcast(gone), key, "left_anti")
    bits = KeyBits(gone, key, count)
    flag = "__stays"
    while flag in frame.columns:
        flag += "_"
    chance = bits.within(stay.select(key).distinct(), key).withColumn(flag, F.lit(True))
    return bits.without(frame.join(F.broadcast(chance), key, "left"), key, flag).select(*[f"`{c}`" for c in frame.columns])
