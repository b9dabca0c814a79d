"""Token ids as raw binary shards with a minimal perfect hash index.

A shard file holds, in ascending id order of its documents:

    magic  counts and sizes  index  offsets  fingerprints  keys  raw ids

The index is a minimal perfect hash: levels of bit arrays in which each key has
a bit of its own, or moves on to the next level; the rank of that bit is the
key's slot. The slot's fingerprint tells keys of the shard from others, and its
offset leads to the ids: in a shard that is read, a key costs a few bit tests
and one slice, whatever its size. Over all shards, hash buckets hold the same kind
of index from a key to its shard's file and offset (``write_index``, ``lookup``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkb.llm.tokens import encoder
from loomkb.session import table
from loomkb.storage import materialize, scratch_path

MAGIC = b"LKSHARD1"
HEADER = struct.Struct("<8sqqqqii")  # magic, shard id, documents, ids, bytes of the index, bytes per id, null keys
#: A shard is closed at so many ids.
SHARD_IDS = 2_000_000
#: Memory of a worker for ids of pieces.
PIECE_BYTES = 160 << 20
#: Rows taken from Arrow at a time; seed of the numbers that split rows of one id.
ROWS, SEED = 256, 7
#: What an index slot holds.
ENTRY = np.dtype([("print", "<u4"), ("file", "<u4"), ("at", "<i8"), ("n", "<i8")])
GAMMA, SEED_STEP = 1.5, 0x9E3779B97F4A7C15


def key_hashes(ids: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """64-bit hashes of (id, how many rows of this id came before)."""
    raw = np.stack([ids.astype("<i8"), repeats.astype("<i8")], axis=1).tobytes()
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[i : i + 16]) for i in range(0, len(raw), 16)), np.uint64, len(ids))


def mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((SEED_STEP * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slots 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        """``levels``: bit arrays as bytes, eight bits each, lowest bit first."""
        self.bits = [np.unpackbits(b, bitorder="little") for b in levels]
        self.levels, self.starts = levels, np.cumsum([0] + [int(b.sum()) for b in self.bits])
        self.ranks = [np.cumsum(b) - b for b in self.bits]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            m = max(8, int(np.ceil(len(left) * GAMMA / 8)) * 8)
            at = (mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            counts = np.bincount(at, minlength=m)
            levels.append(np.packbits(counts == 1, bitorder="little"))
            left = left[counts[at] > 1]
            if len(levels) > 200:
                raise ValueError("equal keys")
        return cls(levels)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; for keys the hash was not built for, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for i, bits in enumerate(self.bits):
            if not len(todo):
                break
            at = (mix(keys[todo], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[todo[hit]] = self.starts[i] + self.ranks[i][at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(b) for b in self.levels], "<i8")
        return struct.pack("<q", len(sizes)) + sizes.tobytes() + b"".join(b.tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: memoryview) -> PerfectHash:
        (n,) = struct.unpack_from("<q", data)
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8), 8 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint8, size, at))
            at += int(size)
        return cls(levels)


def repeats_of(ids: np.ndarray) -> np.ndarray:
    """For sorted ids, how many equal ones come before each."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))


def write_shard(shard: int, keys: list[int | None], payloads: list[bytes], width: int) -> bytes:
    """Bytes of a shard. ``keys`` ascend, nulls first; payloads are ids of ``width`` bytes each."""
    nulls = sum(k is None for k in keys)
    ids = np.array([0] * nulls + keys[nulls:], np.int64)
    repeats = np.r_[-1 - np.arange(nulls), repeats_of(ids[nulls:])].astype(np.int64)
    hashes = key_hashes(ids, repeats)
    index = PerfectHash.build(hashes)
    slots, n = index.slot(hashes), len(keys)
    ends = np.cumsum([len(p) // width for p in payloads], dtype=np.int64) if n else np.zeros(0, np.int64)
    order = np.empty(n, "<i8")
    order[slots] = np.arange(n)
    prints = np.empty(n, "<u4")
    prints[slots] = (hashes >> np.uint64(32)).astype("<u4")
    dumped = index.dump()
    total = int(ends[-1]) if n else 0
    head = HEADER.pack(MAGIC, shard, n, total, len(dumped), width, nulls)
    return b"".join([head, dumped, np.r_[0, ends].astype("<i8").tobytes(), order.tobytes(), prints.tobytes(), ids.astype("<i8").tobytes(), *payloads])


class Shard:
    """A shard read back: documents in order, or one by its key."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.id, self.n, self.total, index_size, self.width, self.nulls = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.index = PerfectHash.load(view[at : at + index_size])
        at += index_size
        self.offsets = np.frombuffer(view, "<i8", self.n + 1, at)
        at += 8 * (self.n + 1)
        self.order = np.frombuffer(view, "<i8", self.n, at)
        at += 8 * self.n
        self.prints = np.frombuffer(view, "<u4", self.n, at)
        at += 4 * self.n
        self.keys = np.frombuffer(view, "<i8", self.n, at)
        at += 8 * self.n
        if len(view) < at + self.total * self.width:
            raise ValueError("token shard is cut off")
        self.ids = np.frombuffer(view, f"<u{self.width}", self.total, at)

    def find(self, keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Position of each document in the shard; -1 for keys that it does not hold."""
        hashes = key_hashes(keys, repeats)
        if self.n == 0:
            return np.full(len(keys), -1, np.int64)
        slots = self.index.slot(hashes)
        same = (slots >= 0) & (self.prints[slots] == (hashes >> np.uint64(32)).astype(np.uint32))
        return np.where(same, self.order[slots], -1)

    def lookup(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        """Ids of the document ``key``; None where the shard does not hold it."""
        k, r = (0, -1 - repeat) if key is None else (key, repeat)
        at = int(self.find(np.array([k]), np.array([r]))[0])
        return None if at < 0 else self.ids[self.offsets[at] : self.offsets[at + 1]]

    def all_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys in order with their repeat numbers; nulls come first, with negative numbers."""
        repeats = np.r_[-1 - np.arange(self.nulls), repeats_of(self.keys[self.nulls :])].astype(np.int64)
        return self.keys.astype(np.int64), repeats


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> None:
    """Tokenize whole texts and write shards in ascending id order below ``path``.

    Rows are dealt by ranges of the id before tokenizing, so the texts move
    once and the range sampling never tokenizes; a hash of the text and a
    seeded number split an id that many rows share. Null and empty texts are
    the end id alone, a text of any length is one document, null ids come
    first, and an empty table gives no shard. Rows of one id follow each other
    in an order of their own.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    pairs = pairs.withColumns({"h": F.xxhash64("t"), "r": F.rand(SEED)})
    order = [F.col("k").asc_nulls_first(), "h", "r"]
    ranged = pairs.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k", "t")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, tokenizer_path, PIECE_BYTES)
        end = np.array([end_id], encode.dtype).tobytes()
        part, seq, keys, payloads, held = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            data = write_shard(part << 32 | seq, keys, payloads, encode.dtype.itemsize)
            return pa.RecordBatch.from_pydict({"shard": pa.array([data], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                for key, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist())):
                    keys.append(key)
                    payloads.append(ids + end)
                    held += len(ids) // encode.dtype.itemsize + 1
                    if held >= SHARD_IDS:
                        yield closed()
                        seq, keys, payloads, held = seq + 1, [], [], 0
        if keys:
            yield closed()

    _write_values(ranged.mapInArrow(shards, "shard binary"), "shard", f"{path}/shards")


def _write_values(files: DataFrame, column: str, path: str, by: Sequence[str] = ()) -> None:
    """One file for each row: the text writer stores the bytes of a string as they are."""
    out = files.select(*by, F.col(column).cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 1).partitionBy(*by).text(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/shards").select("path", "content")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, found by its key.

    ``start`` counts the ids of all documents before it over all shards.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                if not data or data == b"\n":
                    continue
                shard = Shard(data)
                keys, repeats = shard.all_keys()
                at = shard.find(keys, repeats)
                if (at < 0).any():
                    raise ValueError("the index misses keys of its shard")
                starts, ends = shard.offsets[at], shard.offsets[at + 1]
                crc = [zlib.crc32(shard.ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts, ends)]
                doc_ids = pd.array(keys, "Int64")
                doc_ids[: shard.nulls] = pd.NA
                yield pd.DataFrame({"shard": shard.id, "doc_id": doc_ids, "at": starts, "n_tokens": ends - starts, "ids_crc32": crc})

    files = _shards(spark, path).select("content")
    rows = materialize(files.mapInPandas(parsed, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"), "read")
    part = F.shiftright("shard", 32).alias("part")
    totals = materialize(rows.groupBy(part, "shard").agg(F.sum("n_tokens").alias("total")), "totals")

    def before(*by: str) -> Column:
        window = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("total").over(window), F.lit(0))

    # shards are numbered inside the partition that wrote them: the sums run there, and over one row for each partition
    parts = totals.groupBy("part").agg(F.sum("total").alias("total")).select("part", before("part").alias("first"))
    bases = totals.select("part", "shard", before("part", "shard").alias("inside")).join(parts, "part")
    bases = materialize(bases.select("shard", (F.col("first") + F.col("inside")).alias("base")), "bases")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def write_index(spark: SparkSession, path: str, keys_per_bucket: int = 1 << 20) -> None:
    """Perfect hash index over the keys of all shards below ``path``: from a key to its shard file and offset.

    Keys are dealt to buckets by hash, each with a perfect hash, fingerprints,
    shard numbers and offsets of its own; the number of buckets grows with the
    keys. The first row of an id is indexed; null ids are not.
    """

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                if not data or data == b"\n":
                    continue
                shard = Shard(data)
                keys, repeats = shard.all_keys()
                first = np.flatnonzero(repeats == 0)
                at = shard.offsets[first]
                yield pd.DataFrame({"k": keys[first], "file": file, "at": at, "n": shard.offsets[first + 1] - at, "shard": shard.id})

    entries = _shards(spark, path).mapInPandas(located, "k long, file string, at long, n long, shard long")
    # an id may go on in the next shard: its first row counts
    entries = materialize(entries.groupBy("k").agg(F.min(F.struct("shard", "at", "n", "file")).alias("e")).select("k", "e.*"), "entries")
    count = max(1, -(-entries.count() // keys_per_bucket))
    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(count)).cast("int"))

    def indexed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        files, which = np.unique(group["file"].to_numpy(str), return_inverse=True)
        hashes = key_hashes(group["k"].to_numpy(np.int64), np.zeros(len(group), np.int64))
        index = PerfectHash.build(hashes)
        slots, dumped, names = index.slot(hashes), index.dump(), "\n".join(files).encode()
        table = np.zeros(len(group), ENTRY)
        table["print"][slots] = (hashes >> np.uint64(32)).astype("<u4")
        table["file"][slots], table["at"][slots], table["n"][slots] = which, group["at"], group["n"]
        head = struct.pack("<qqq", len(group), len(dumped), len(names))
        return pd.DataFrame({"bucket": [key[0]], "buckets": [count], "data": [head + dumped + names + table.tobytes()]})

    built = dealt.groupBy("bucket").applyInPandas(indexed, "bucket int, buckets int, data binary")
    _write_values(built, "data", f"{path}/index", ("buckets", "bucket"))


class BucketIndex:
    """An index bucket read back."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        n, size, names = struct.unpack_from("<qqq", view)
        self.hash = PerfectHash.load(view[24 : 24 + size])
        self.files = bytes(view[24 + size : 24 + size + names]).decode().split("\n")
        self.entries = np.frombuffer(view, ENTRY, n, 24 + size + names)

    def find(self, keys: np.ndarray) -> list[tuple[str, int, int] | None]:
        """(file, first id, number of ids) of each key; None for keys that no shard holds."""
        hashes = key_hashes(keys, np.zeros(len(keys), np.int64))
        out: list[tuple[str, int, int] | None] = []
        for slot, h in zip(self.hash.slot(hashes), hashes):
            e = self.entries[slot] if slot >= 0 else None
            same = e is not None and e["print"] == h >> np.uint64(32)
            out.append((self.files[e["file"]], int(e["at"]), int(e["n"])) if same else None)
        return out


def lookup(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the distinct ``keys`` that some shard below ``path`` holds.

    Each key asks its bucket for a file and an offset. The index buckets and the
    shard files that hold keys are read whole, all others not at all; no shard
    is searched. Null keys find nothing.
    """
    index = spark.read.format("binaryFile").load(f"{path}/index").select("buckets", "bucket", "content")
    row = index.select("buckets").first()
    if row is None:
        return spark.createDataFrame([], "doc_id long, ids array<int>")
    wanted = keys.select(F.col(id_col).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(row["buckets"])).cast("int"))

    def found(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(held):
            ids = asked["k"].to_numpy(np.int64)
            rows = [(int(k), *e) for k, e in zip(ids, BucketIndex(held["content"].iloc[0]).find(ids)) if e]
        return pd.DataFrame(rows, columns=["k", "path", "at", "n"])

    placed = wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(found, "k long, path string, at long, n long")
    placed = materialize(placed, "placed")

    def sliced(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(held):
            shard = Shard(held["content"].iloc[0])
            for k, at, n in zip(asked["k"], asked["at"], asked["n"]):
                # the fingerprint may lie: the shard knows its keys
                if shard.keys[np.searchsorted(shard.offsets, at)] == k:
                    rows.append((int(k), shard.ids[at : at + n].astype(np.int32)))
        return pd.DataFrame(rows, columns=["doc_id", "ids"])

    files = _shards(spark, path).join(placed.select("path").distinct(), "path", "left_semi")
    return placed.groupBy("path").cogroup(files.groupBy("path")).applyInPandas(sliced, "doc_id long, ids array<int>")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_shards(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", end_id=2)
    return read_shards(spark, path)
