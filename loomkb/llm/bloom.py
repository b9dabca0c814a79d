"""Bloom filters as columns: built by aggregations, tested by hash and bit operations inside a scan."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkb.storage import materialize

#: Bits that a probe tests in its word. With a word for each key and probe, about 2 ^ -PASSING of other keys pass a probe.
BITS, PASSING = 6, 13
#: Words that one task gathers: 8 MB.
SHARD_WORDS = 1 << 20


@dataclass(frozen=True)
class Level:
    words: DataFrame  # (shard, words): arrays of at most SHARD_WORDS words
    size: int
    probes: int
    seed: int

    def bits(self) -> Column:
        """The arrays of words, as one value: bind it to a name before it is tested inside of a lambda."""
        shards = range(-(-self.size // SHARD_WORDS))
        return F.array(*[self.words.where(F.col("shard") == i).select("words").scalar() for i in shards])

    def holds(self, key: Column, bits: Column | None = None) -> Column:
        """All tested bits of ``key`` are set in this level, whose ``bits`` may be bound."""
        one = self.words.select("words").scalar() if bits is None and self.size <= SHARD_WORDS else None
        bits = self.bits() if bits is None and one is None else bits
        tests = []
        for at, mask in probes_of(key, self.size, self.probes, self.seed):
            words = F.element_at(bits, F.shiftright(at, SHARD_WORDS.bit_length() - 1) + 1) if one is None else one
            place = at.bitwiseAND(F.lit(SHARD_WORDS - 1)) if one is None else at
            tests.append(F.element_at(words, place + 1).bitwiseAND(mask) == mask)
        return reduce(Column.__and__, tests)


def probes_of(key: Column, size: int, probes: int, seed: int) -> list[tuple[Column, Column]]:
    """(number of the word, its bits) of each probe of a key."""
    out = []
    for i in range(probes):
        at = F.pmod(F.xxhash64(key, F.lit(1000 * seed + 2 * i)), F.lit(size)).cast("int")
        h = F.xxhash64(key, F.lit(1000 * seed + 2 * i + 1))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * j).bitwiseAND(F.lit(63).cast("long")).cast("int")) for j in range(BITS)]
        out.append((at, reduce(Column.bitwiseOR, bits)))
    return out


def build_level(keys: DataFrame, others: int, seed: int, most: int | None = None) -> Level:
    """A Bloom filter of the column ``key`` that few of ``others`` other keys pass.

    It has a word for each key and probe, or ``most`` words; with more keys
    than that it lets more other keys pass.
    """
    count = max(1, keys.count())
    probes = max(1, math.ceil(math.log2(max(1, others) / count) / PASSING)) if others > count else 1
    size = min(count * probes, most or count * probes)
    pairs = [F.struct(at.alias("at"), mask.alias("mask")) for at, mask in probes_of(F.col("key"), size, probes, seed)]
    hit = keys.select(F.inline(F.array(*pairs))).groupBy("at").agg(F.bit_or("mask").alias("bits"))
    every = keys.sparkSession.range(size).select(F.col("id").cast("int").alias("at")).join(hit, "at", "left")
    entry = F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    shard = F.shiftright("at", SHARD_WORDS.bit_length() - 1).alias("shard")
    words = every.groupBy(shard).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["bits"]).alias("words"))
    return Level(materialize(words, "level"), size, probes, seed)


