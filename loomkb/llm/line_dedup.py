"""Repeated lines dropped by probing a sharded minimal perfect hash.

1. Each task reads whole documents in blocks of bounded size and hashes the keys
   of their lines to 128 bits. A block holds every distinct hash once, with how
   many of its documents hold the line and the id that may keep it: a line of a
   third of all documents travels as one row per block.
2. The distinct hashes, summed over blocks, are dealt to shards. A shard is a
   minimal perfect hash over its hashes; at a hash's slot lie a fingerprint and
   the number of documents in the narrowest integers that hold them, and ids
   that keep a line only for lines that are dropped elsewhere.
3. Blocks ask the shards about their distinct hashes; only lines to be dropped
   are answered. Lines are never joined with lines, and texts are not moved.
4. Answers meet their blocks' documents, which gives a mask of lines for each
   document that loses some; the masks meet the texts in one join.

A shard is asked about as many hashes as it has on average, and once more per
block for a line that all blocks hold.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.llm.token_shards import PerfectHash, mix
from loomkb.session import table
from loomkb.storage import materialize

#: White space that does not count at the ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
#: A block is closed at so many bytes of text or distinct lines; hashes that a shard is asked about on average.
BLOCK_BYTES, BLOCK_LINES, SHARD_LINES, ROWS = 32 << 20, 1 << 17, 1 << 18, 256
#: Column names of the results.
RESULTS = ("n_lines", "n_dropped")
BLOCKS = "block long, doc_id long, digest binary, lines array<int>, high array<long>, low array<long>, n array<long>, best array<long>"


@dataclass(frozen=True)
class Settings:
    """Lines of at least ``min_chars`` code points found in at least ``min_docs`` documents; ``keep`` names the id that keeps its lines."""

    min_docs: int = 3
    min_chars: int = 20
    keep: str = "max"


def line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """128-bit hash of the key of each line; None for keys shorter than ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes lower-case A-Z alone
        key = line.strip(BLANKS)
        long = len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(blake2b(key, digest_size=16).digest() if long else None)
    return out


class LineIndex:
    """A shard: counts of documents by line hash, and ids that keep a line where the count reaches ``min_docs``."""

    HEADER = struct.Struct("<qqqqq")  # lines, salt, bytes of the hash, bytes of a count, lines with an id

    def __init__(self, data: bytes):
        view = memoryview(data)
        self.n, self.salt, size, width, hot = self.HEADER.unpack_from(view)
        at = self.HEADER.size
        self.hash = PerfectHash.load(view[at : at + size])
        at += size
        self.prints = np.frombuffer(view, "<u4", self.n, at)
        at += 4 * self.n
        self.counts = np.frombuffer(view, f"<u{width}", self.n, at)
        at += width * self.n
        self.keepers = np.frombuffer(view, "<i8", hot, at)
        at += 8 * hot
        self.nameless = np.frombuffer(view, np.uint8, hot, at)

    @staticmethod
    def keys(high: np.ndarray, low: np.ndarray, salt: int) -> np.ndarray:
        return mix(high.astype(np.uint64), 1000 + salt) ^ mix(low.astype(np.uint64), 2000 + salt)

    @staticmethod
    def fingerprints(low: np.ndarray) -> np.ndarray:
        return (mix(low.astype(np.uint64), 3000) >> np.uint64(32)).astype("<u4")

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, keepers: np.ndarray, nameless: np.ndarray, min_docs: int) -> bytes:
        """``high`` and ``low`` are distinct pairs; ``nameless`` marks lines that only documents without an id hold."""
        salt = 0
        while len(np.unique(keys := cls.keys(high, low, salt))) < len(keys):  # 64 bits may collide where 128 do not
            salt += 1
        index = PerfectHash.build(keys)
        slots, dumped = index.slot(keys), index.dump()
        order = np.empty(len(keys), np.int64)
        order[slots] = np.arange(len(keys))
        counts = counts[order]
        width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 1 << 8 * w)
        hot = order[counts >= min_docs]
        head = cls.HEADER.pack(len(keys), salt, len(dumped), width, len(hot))
        arrays = [cls.fingerprints(low)[order], counts.astype(f"<u{width}"), keepers[hot].astype("<i8"), nameless[hot].astype(np.uint8)]
        return b"".join([head, dumped, *[a.tobytes() for a in arrays]])

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of documents, slot) of each hash; 0 documents for hashes that the shard does not hold."""
        slots = self.hash.slot(self.keys(high, low, self.salt))
        held = (slots >= 0) & (self.prints[slots] == self.fingerprints(low)) if self.n else np.zeros(len(high), bool)
        slots = np.where(held, slots, 0)
        return np.where(held, self.counts[slots].astype(np.int64) if self.n else 0, 0), slots

    def keeper(self, slots: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(id that keeps the line, whether it is null) at slots of lines that reach ``min_docs``."""
        rank = np.cumsum(self.counts >= min_docs) - 1
        return self.keepers[rank[slots]], self.nameless[rank[slots]] == 1


class Block:
    """Documents of a task and the distinct hashes of their lines."""

    def __init__(self, number: int, keep_max: bool):
        self.number, self.keep_max = number, keep_max
        self.at: dict[bytes, int] = {}
        self.n: list[int] = []
        self.best: list[int | None] = []
        self.docs: list[tuple[int | None, bytes, list[int]]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, digest: bytes, text: bytes, hashes: list[bytes | None]) -> None:
        self.bytes += len(text)
        lines = [-1 if h is None else self.at.setdefault(h, len(self.at)) for h in hashes]
        new = len(self.at) - len(self.n)
        self.n.extend([0] * new)
        self.best.extend([None] * new)
        for i in set(lines) - {-1}:
            self.n[i] += 1
            best = self.best[i]
            if doc_id is not None and (best is None or (doc_id > best) == self.keep_max):
                self.best[i] = doc_id
        if max(lines) >= 0:
            self.docs.append((doc_id, digest, lines))

    @property
    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.at) >= BLOCK_LINES

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        """The block's hashes as one row, then its documents."""
        halves = np.frombuffer(b"".join(self.at), "<i8").reshape(-1, 2)
        none = [None] * len(self.docs)
        columns = {
            "block": [self.number] * (len(self.docs) + 1),
            "doc_id": [None, *[d[0] for d in self.docs]],
            "digest": [None, *[d[1] for d in self.docs]],
            "lines": [None, *[d[2] for d in self.docs]],
            "high": [halves[:, 0], *none],
            "low": [halves[:, 1], *none],
            "n": [self.n, *none],
            "best": [self.best, *none],
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("lines", pa.list_(pa.int32()))]
    + [(c, pa.list_(pa.int64())) for c in ("high", "low", "n", "best")]
)


def drop_masks(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, digest and stays (one boolean per line) of the documents that lose lines; ``docs`` has doc_id, text and digest."""
    spark = docs.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq = TaskContext.get().partitionId() << 32, 0
        block = Block(first, settings.keep == "max")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                for doc_id, digest, text in zip(*[c.to_pylist() for c in rows.columns]):
                    block.add(doc_id, digest, text, line_hashes(text, settings.min_chars))
                    if block.full:
                        yield block.rows(BLOCK_SCHEMA)
                        seq += 1
                        block = Block(first | seq, settings.keep == "max")
        if block.docs:
            yield block.rows(BLOCK_SCHEMA)

    rows = materialize(docs.select("doc_id", "digest", F.col("text").cast("binary").alias("text")).mapInArrow(blocks, BLOCKS), "blocks")
    held = rows.where("high IS NOT NULL")
    total = held.agg(F.sum(F.size("high"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_LINES))
    entry = F.explode(F.arrays_zip("high", "low", "n", "best", F.sequence(F.lit(0), F.size("high") - 1).alias("at")))
    asked = held.where(F.size("high") > 0).select("block", entry.alias("e")).select("block", "e.*", F.pmod("e.high", F.lit(shards)).alias("shard"))
    best = F.max if settings.keep == "max" else F.min
    lines = asked.groupBy("shard", "high", "low").agg(F.sum("n").alias("n"), best("best").alias("best"))

    def indexed(key: tuple, group: pa.Table) -> pa.Table:
        best = group["best"]
        columns = [group[c].to_numpy() for c in ("high", "low", "n")]
        data = LineIndex.build(*columns, best.fill_null(0).to_numpy(), best.is_null().to_numpy(), settings.min_docs)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    index = materialize(lines.groupBy("shard").applyInArrow(indexed, "shard long, data binary"), "index")
    found = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("keeper", pa.int64())])

    def probed(questions: pa.Table, shard: pa.Table) -> pa.Table:
        if not questions.num_rows:
            return found.empty_table()
        held = LineIndex(shard["data"][0].as_py())
        counts, slots = held.probe(questions["high"].to_numpy(), questions["low"].to_numpy())
        if (counts == 0).any():
            raise ValueError("the index misses lines of its shard")
        hit = np.flatnonzero(counts >= settings.min_docs)
        keeper, nameless = held.keeper(slots[hit], settings.min_docs)
        asked = questions.take(pa.array(hit))
        return pa.Table.from_arrays([asked["block"], asked["at"], pa.array(keeper, mask=nameless)], schema=found)

    questions = asked.select("shard", "block", "at", "high", "low")
    answers = questions.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probed, "block long, at int, keeper long")
    masks = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("stays", pa.list_(pa.bool_()))])

    def masked(documents: pa.Table, dropped: pa.Table) -> pa.Table:
        if not documents.num_rows or not dropped.num_rows:
            return masks.empty_table()
        ends = np.cumsum(documents["lines"].combine_chunks().value_lengths().to_numpy())
        lines = documents["lines"].combine_chunks().flatten().to_numpy()
        size = max(int(lines.max(initial=0)), int(dropped["at"].to_numpy().max())) + 2
        hit, keeper, nameless = np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, bool)
        at = dropped["at"].to_numpy()
        hit[at], keeper[at] = True, dropped["keeper"].fill_null(0).to_numpy()
        nameless[at] = dropped["keeper"].is_null().to_numpy()
        doc_of = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        ids, null = documents["doc_id"].fill_null(0).to_numpy()[doc_of], documents["doc_id"].is_null().to_numpy()[doc_of]
        # -1, a line too short, asks the last place, which is never hit
        keeps = (null & nameless[lines]) | (~null & ~nameless[lines] & (ids == keeper[lines]))
        stays = ~hit[lines] | keeps
        loses = np.flatnonzero(np.bincount(doc_of[~stays], minlength=len(ends)))
        starts = np.r_[0, ends[:-1]]
        kept = [stays[starts[i] : ends[i]] for i in loses]
        chosen = documents.take(pa.array(loses))
        return pa.Table.from_arrays([chosen["doc_id"], chosen["digest"], pa.array(kept, pa.list_(pa.bool_()))], schema=masks)

    documents = rows.where("high IS NULL").select("block", "doc_id", "digest", "lines")
    made = documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(masked, "doc_id long, digest binary, stays array<boolean>")
    return made.dropDuplicates(["doc_id", "digest"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without repeated lines, with n_lines (before dropping) and n_dropped.

    A text is split at every ``\\n``; null and empty texts are one empty line.
    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys long enough and found in enough documents lose all their lines except
    in the document whose id ``keep`` names; there all of them stay. Each row
    counts as a document; rows of the id that stays all keep the line, and null
    ids lose against any other. Long texts are taken whole. An empty table
    stays empty. Other columns come along; those named like a result column are
    replaced. Lines are told apart by a cryptographic hash of 128 bits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__text": text, "__digest": F.unhex(F.md5(text))})
    masks = drop_masks(keyed.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"), F.col("__digest").alias("digest")), settings)
    masks = masks.select(F.col("doc_id").alias("__mask_id"), F.col("digest").alias("__mask_digest"), "stays")
    same = keyed["__id"].eqNullSafe(masks["__mask_id"]) & (keyed["__digest"] == masks["__mask_digest"])
    found = keyed.join(masks.withColumnRenamed("stays", "__stays"), same, "left")
    left = F.array_join(F.filter(F.split("__text", "\n"), lambda line, i: F.element_at("__stays", i + 1)), "\n")
    n_lines = F.length("__text") - F.length(F.translate("__text", "\n", "")) + 1
    n_dropped = F.when(F.col("__stays").isNull(), 0).otherwise(F.size(F.filter("__stays", lambda s: ~s)))
    kept_text = F.when(F.col("__stays").isNull(), F.col("__text")).otherwise(left)
    kept = [c for c in docs.columns if c not in RESULTS]
    return found.select(
        *[kept_text.alias(c) if c == text_col else keyed[c] for c in kept],
        n_lines.cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM d),
keyed AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.i, k.line, h.key IS NOT NULL AND h.keeper <> k.doc_id AS dropped FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
