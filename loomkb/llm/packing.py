"""Hierarchical packing of documents into windows of several context sizes.

Each task packs its share in chunks of bounded size:

1. a document longer than the longest window gives full windows and a rest;
2. rests are routed to the smallest tier that holds them;
3. each tier, longest first, is packed in windows of its own size: a window
   opens with the tier's longest piece, and its gap is filled with the longest
   pieces of the shorter tiers that fit;
4. what no whole piece fills is filled by cutting one, whose rest is routed
   again; so only the very last window of a task stays open, and it is dealt
   out to sequences whose lengths are powers of two, which need no padding;
5. sequences are dealt to step groups so that each step has its share of every
   context size, and close sums of ids and of attention cost.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.llm.tokens import encoder
from loomkb.session import table

WINDOW = 2048
#: Context sizes, longest first; powers of two, so full windows need no padding.
TIERS = (2048, 1024, 512, 256)
#: Ids packed at a time, and rows taken from Arrow at a time: bound a task's memory.
CHUNK_IDS, ROWS = 2_000_000, 256
#: Sequences of a training step.
STEP = 16

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, tier int, step long"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(c, pa.int32() if c == "tier" else pa.int64()) for c in COLUMNS])

#: A document's number in the task, first id, number of ids.
Piece = tuple[int, int, int]


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The smallest context that holds ``length`` ids."""
    return next((t for t in reversed(tiers) if t >= length), tiers[0])


class Pool:
    """Pieces that wait in their tiers, found by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        #: Per tier: the lengths that wait, sorted, and the pieces of each.
        self.lengths: dict[int, list[int]] = {t: [] for t in tiers}
        self.waiting: dict[int, list[Piece]] = {}

    def route(self, piece: Piece) -> None:
        n = piece[2]
        if n not in self.waiting:
            bisect.insort(self.lengths[tier_of(n, self.tiers)], n)
            self.waiting[n] = []
        self.waiting[n].append(piece)

    def longest(self, tier: int, most: int | None = None) -> Piece | None:
        """Take the longest piece of ``tier`` with at most ``most`` ids."""
        lengths = self.lengths[tier]
        at = len(lengths) - 1 if most is None else bisect.bisect_right(lengths, most) - 1
        if at < 0:
            return None
        n = lengths[at]
        piece = self.waiting[n].pop()
        if not self.waiting[n]:
            del self.waiting[n], lengths[at]
        return piece

    def filler(self, tier: int, gap: int) -> Piece | None:
        """The longest piece for a gap in a window of ``tier``: from that tier or a shorter one."""
        for t in self.tiers:
            if t <= tier:
                piece = self.longest(t, gap)
                if piece:
                    return piece
        return None

    def cut(self, tier: int, gap: int) -> Piece | None:
        """A part of ``gap`` ids of a longer piece of ``tier`` or a shorter one; its rest is routed again."""
        for t in self.tiers:
            if t <= tier:
                piece = self.longest(t)
                if piece:
                    doc, start, n = piece
                    self.route((doc, start + gap, n - gap))
                    return doc, start, gap
        return None


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, each as long as one of the ``tiers`` (longest first), and the pieces of the window that is not full.

    Pieces have lengths from 1.
    """
    full, pool = [], Pool(tiers)
    for doc, start, n in pieces:
        while n >= tiers[0]:
            full.append([(doc, start, tiers[0])])
            start, n = start + tiers[0], n - tiers[0]
        if n:
            pool.route((doc, start, n))
    for tier in tiers:
        while first := pool.longest(tier):
            sequence, gap = [first], tier - first[2]
            while gap:
                piece = pool.filler(tier, gap) or pool.cut(tier, gap)
                if piece is None:
                    return full, sequence
                sequence.append(piece)
                gap -= piece[2]
            full.append(sequence)
    return full, []


def powers(rest: list[Piece]) -> list[list[Piece]]:
    """Deal the ids of an open window to sequences whose lengths are powers of two."""
    out, left = [], list(rest)
    total = sum(p[2] for p in left)
    while total:
        size = 1 << (total.bit_length() - 1)
        sequence, room = [], size
        while room:
            doc, start, n = left.pop(0)
            take = min(n, room)
            sequence.append((doc, start, take))
            if n > take:
                left.insert(0, (doc, start + take, n - take))
            room -= take
        out.append(sequence)
        total -= size
    return out


def steps_of(sequences: list[list[Piece]], size: int = STEP) -> list[int]:
    """Step number of each sequence, for steps of ``size`` sequences.

    Sorted by attention cost and dealt out to and fro, so every step gets its
    share of each context size, and ids and costs of the steps are close.
    """
    cost = [sum(n * n for _, _, n in s) for s in sequences]
    length = [sum(n for _, _, n in s) for s in sequences]
    count = -(-len(sequences) // size)
    out = [0] * len(sequences)
    for rank, i in enumerate(sorted(range(len(sequences)), key=lambda i: (-tier_of(length[i]), -cost[i], i))):
        lap, at = divmod(rank, count)
        out[i] = at if lap % 2 == 0 else count - 1 - at
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece; see SCHEMA. ``tier`` is the smallest context that holds the sequence.

    Null and empty texts are the end id alone; a text of any length is packed
    whole. Null ids are packed like others, and rows of one id are documents of
    their own. An empty table gives no sequences. Other columns are not looked
    at. Map-only: nothing is shuffled, and a task that runs again makes the
    same sequences. A task's last window is cut into powers of two, at most
    one sequence of each size.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, tokenizer_path)
        end = np.array([end_id], encode.dtype).tobytes()
        width, base = encode.dtype.itemsize, TaskContext.get().partitionId() << 36
        made = steps_made = held = 0
        doc_ids: list[int | None] = []
        payloads: list[bytes] = []
        carried: list[Piece] = []
        first_new = 0

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made, steps_made
            steps, out = steps_of(sequences), []
            for sequence, step in zip(sequences, steps):
                length, offset = sum(p[2] for p in sequence), 0
                for doc, start, n in sequence:
                    ids = np.frombuffer(payloads[doc], encode.dtype)
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    out.append((doc_ids[doc], start, n, crc, len(ids), base + made, offset, length, tier_of(length, tiers), base + steps_made + step))
                    offset += n
                made += 1
            steps_made += max(steps) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal doc_ids, payloads, carried, held, first_new
            fresh = [(d, 0, len(payloads[d]) // width) for d in range(first_new, len(payloads))]
            full, rest = pack([*carried, *fresh], tiers)
            if last:
                full, rest = [*full, *powers(rest)], []
            if full:
                yield rows(full)
            # only documents of the open window are still needed
            kept = {d: i for i, d in enumerate(dict.fromkeys(d for d, _, _ in rest))}
            doc_ids, payloads = [doc_ids[d] for d in kept], [payloads[d] for d in kept]
            carried = [(kept[d], s, n) for d, s, n in rest]
            held, first_new = 0, len(payloads)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    payloads.append(ids + end)
                    held += len(ids) // width + 1
                    if held >= CHUNK_IDS:
                        yield from flush(False)
        yield from flush(True)

    pairs = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return pairs.mapInArrow(packed, SCHEMA)


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
