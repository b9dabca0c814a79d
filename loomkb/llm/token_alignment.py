"""Alignment of two tokenizers' ids over the same bytes.

1. Both tokenizers begin anew at a single space between other characters, so
   texts are cut there, and a block of documents holds each distinct piece once.
2. Both encode the block's pieces. Over the bytes of all of them one packed
   bitset marks where tokens of A end, another one where tokens of B end; their
   AND marks the cuts that both share.
3. Popcounts rank each shared cut in both sets: the ranks are the ranges of
   tokens between cuts (groups), and the tokens that end there are linked. A
   document's groups are those of its pieces, one after another.
4. A block holds each distinct pair of linked ids once, with its count. Counts
   are summed over all blocks, and the best count of each B id is found.
5. Blocks get the counts of their pairs back, and each document sums its own.

A pair that all documents hold travels as one row per block; texts and token
ids are not moved.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.llm.tokens import byte_tokens, encoder
from loomkb.session import table
from loomkb.storage import materialize

#: A block is closed at so many characters of text; whole tokens are held for so many; rows taken from Arrow at a time.
BLOCK_CHARS, TOKEN_CHARS, ROWS = 8 << 20, 1 << 20, 256
#: Memory of a worker for A's ids of pieces.
PIECE_BYTES = 48 << 20
#: Where both tokenizers begin anew.
CUT = re.compile(r"(?<=[^ ])(?= \S)")
ODD_SPACE = re.compile(r" (?:\s|\Z)")


def pieces_of(text: str) -> list[str]:
    """A space and the text, cut where both tokenizers begin anew; without the space that each piece begins with."""
    return [p[1:] for p in CUT.split(" " + text)] if text[0] == " " or ODD_SPACE.search(text) else text.split(" ")


@dataclass(frozen=True)
class Tokenizers:
    """``a``: a byte-level tokenizer file, encoding a space and the text; ``b``: a sentencepiece model, which adds the space."""

    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    a_path: str | None = None
    b_path: str | None = None


@dataclass
class Tokens:
    """Ids of both tokenizers over several texts, where those of each text begin (and the end), and the bytes of each text."""

    a: np.ndarray
    b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    sizes: np.ndarray


class Vocabularies:
    """Both encoders with the bytes of their ids."""

    def __init__(self, names: Tokenizers):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        self.encode_a = encoder(names.a, names.a_path, PIECE_BYTES, PIECE_BYTES // 3, True)
        self.model = model = SentencePieceProcessor(model_file=names.b_path or public_tokenizers.path(names.b))
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        #: No piece has a space after another character, and spaces stay: then no merge crosses a cut.
        self.cuts = not any("\u2581" in p.lstrip("\u2581") for p in pieces) and model.decode(model.encode(" a  b")) == " a  b"
        self.bytes_a = byte_tokens(self.encode_a)
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        if not all(self.bytes_a) or not all(self.bytes_b):
            raise ValueError("a token without bytes has no end of its own")
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        # ids in decimal with what follows them: inside of their group, or at its end
        self.words = [f"{i}{s}".encode() for v, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(v)) for s in ends]

    def pieces(self, text: str) -> list[str]:
        return pieces_of(text) if self.cuts else [text]

    def tokens(self, texts: Sequence[str]) -> Tokens:
        """Tokens of texts behind a space; none of a text that the joined tokens are not."""
        known, odd = self.encode_a.known, self.encode_a
        a = [known[t] if t and " " not in t else next(odd([" " + t])) for t in texts]
        b = self.model.encode(list(texts), num_threads=1)  # it adds the space by itself
        flat_a = np.frombuffer(b"".join(a), self.encode_a.dtype).astype(np.int64)
        flat_b = np.fromiter(chain.from_iterable(b), np.int64, sum(map(len, b)))
        starts_a = np.r_[0, np.cumsum([len(x) for x in a], dtype=np.int64)] // self.encode_a.dtype.itemsize
        starts_b = np.r_[0, np.cumsum([len(x) for x in b], dtype=np.int64)]
        raw = [(" " + t).encode() for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        same = (sums_between(self.sizes_a[flat_a], starts_a) == sizes) & (sums_between(self.sizes_b[flat_b], starts_b) == sizes)
        joined = [(v, ids, b"".join(map(v.__getitem__, ids.tolist()))) for v, ids in ((self.bytes_a, flat_a), (self.bytes_b, flat_b))]
        if not same.all() or any(j != b"".join(raw) for _, _, j in joined):
            for (v, ids, _), starts in zip(joined, (starts_a, starts_b)):
                same &= [b"".join(map(v.__getitem__, ids[s:e].tolist())) == r for s, e, r in zip(starts[:-1], starts[1:], raw)]
            flat_a, flat_b = flat_a[np.repeat(same, np.diff(starts_a))], flat_b[np.repeat(same, np.diff(starts_b))]
            starts_a, starts_b = (np.r_[0, np.cumsum(np.diff(s) * same)] for s in (starts_a, starts_b))
            sizes = sizes * same
        return Tokens(flat_a, flat_b, starts_a, starts_b, sizes)


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each bound to the next one."""
    return np.diff(np.r_[0, np.cumsum(values)][bounds])


class EndBits:
    """Ends of tokens as a packed bitset, with popcounts before each word of 64 bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def of(cls, ends: np.ndarray, size: int) -> EndBits:
        bits = np.zeros(-(-(size + 1) // 64) * 64, bool)
        bits[ends] = True
        return cls(np.packbits(bits, bitorder="little").view("<u8"))

    def __and__(self, other: EndBits) -> EndBits:
        return EndBits(self.words & other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set up to each position, itself included."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        upto = self.words[word] & (np.uint64(2**64 - 1) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(upto)

    def select(self) -> np.ndarray:
        """The positions of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@dataclass
class Aligned:
    """Groups of tokens of several texts; group ``g`` has the tokens from ``to[g - 1]`` to ``to[g]`` of each side."""

    tokens: Tokens
    to_a: np.ndarray
    to_b: np.ndarray
    #: Group at which each text begins, and the end; byte at which each group ends, and at which each text begins.
    groups: np.ndarray
    ends: np.ndarray
    bases: np.ndarray

    @property
    def links(self) -> np.ndarray:
        """The linked pair of ids at the end of each group."""
        return self.tokens.a[self.to_a - 1] << B_BITS | self.tokens.b[self.to_b - 1]


def align(tokens: Tokens, vocabularies: Vocabularies) -> Aligned:
    """Groups of all texts: the last byte of each ends tokens of both sides, so no group spans two."""
    bases = np.r_[0, np.cumsum(tokens.sizes)]
    bits_a = EndBits.of(np.cumsum(vocabularies.sizes_a[tokens.a]), int(bases[-1]))
    bits_b = EndBits.of(np.cumsum(vocabularies.sizes_b[tokens.b]), int(bases[-1]))
    cuts = (bits_a & bits_b).select()
    return Aligned(tokens, bits_a.rank(cuts), bits_b.rank(cuts), np.searchsorted(cuts, bases, "right"), cuts, bases)


def written(block: Aligned, vocabularies: Vocabularies) -> Iterator[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    t, codes = block.tokens, np.empty(len(block.tokens.a) + len(block.tokens.b), np.int64)
    for ids, to, other, first in ((t.a, block.to_a, np.r_[0, block.to_b], 0), (t.b, block.to_b, np.r_[block.to_a, 0], 2 * len(vocabularies.bytes_a))):
        last = np.zeros(len(ids), np.int64)
        last[to - 1] = 1
        group = np.cumsum(last) - last
        # A's tokens come after all B tokens of earlier groups, B's after the A tokens of their own too
        codes[np.arange(len(ids)) + other[group]] = first + 2 * ids + last
    words = list(map(vocabularies.words.__getitem__, codes.tolist()))
    bounds = t.starts_a + t.starts_b
    for start, end in zip(bounds[:-1], bounds[1:]):
        yield b"".join(words[start:end])[:-1]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    """(id, text) of the first two columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            yield from zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def held_until(rows: Iterator[tuple[int | None, str | None]], chars: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Rows in lists that end once they hold ``chars`` characters of text."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[1] or "")
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def _pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def aligned_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: Tokenizers = Tokenizers()) -> DataFrame:
    """doc_id and groups (a, b: ids; end: byte of the text with its space at which the group ends) of each row; nulls as in ``token_links``."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies(tokenizers)
        for rows in held_until(rows_of(batches), TOKEN_CHARS):
            x = align(v.tokens([text for _, text in rows if text]), v)
            a, b = (pa.ListArray.from_arrays(pa.array(np.r_[0, to], pa.int32()), pa.array(t, pa.int32())) for t, to in ((x.tokens.a, x.to_a), (x.tokens.b, x.to_b)))
            text_of = np.searchsorted(x.groups, np.arange(len(x.ends)), "right") - 1
            groups = pa.StructArray.from_arrays([a, b, pa.array(x.ends - x.bases[text_of], pa.int64())], names=["a", "b", "end"])
            starts = x.groups[np.r_[0, np.cumsum([bool(text) for _, text in rows])]]
            ids = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "groups": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), groups)})

    return _pairs(docs, id_col, text_col).mapInArrow(grouped, "doc_id long, groups array<struct<a:array<int>,b:array<int>,end:long>>")


#: Rows of documents (the distinct pieces of each, and how often), and one row of each block (its pairs, their counts, and the pairs of each piece).
BLOCK_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("block", "doc_id", "n_a", "n_b", "n_groups")]
    + [("groups_sha256", pa.string())]
    + [(c, pa.list_(pa.int32())) for c in ("at", "times", "links", "link_starts")]
    + [(c, pa.list_(pa.int64())) for c in ("pairs", "counts")]
)
BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, at array<int>, times array<int>, links array<int>, link_starts array<int>, pairs array<long>, counts array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")])
#: A pair of ids as one number: the A id above the B id.
B_BITS = 32


def linked_block(number: int, rows: list[tuple[int | None, str | None]], v: Vocabularies) -> Iterator[pa.RecordBatch]:
    """Rows of a block's documents, and its own."""
    known: dict[str, int] = {}
    at, bounds = array("i"), [0]
    for _, text in rows:
        if text:
            at.extend([known.setdefault(p, len(known)) for p in v.pieces(text)])
        bounds.append(len(at))
    tokens = v.tokens(list(known))
    x, n = align(tokens, v), len(rows)
    at, bounds, groups = np.array(at, np.int64), np.array(bounds), np.diff(x.groups)
    # a token never has more bytes than its part of the text, so a piece that differs makes its text differ
    same = sums_between(groups[at] == 0, bounds) == 0
    at = at[np.repeat(same, np.diff(bounds))]
    bounds = np.r_[0, np.cumsum(np.where(same, np.diff(bounds), 0))]
    counted = [sums_between(c[at], bounds) for c in (np.diff(tokens.starts_a), np.diff(tokens.starts_b), groups)]
    words = list(written(x, v))
    sha = [sha256(b";".join([words[i] for i in at[s:e].tolist()])).hexdigest() if e > s else "" for s, e in zip(bounds[:-1], bounds[1:])]
    pairs, links = np.unique(x.links, return_inverse=True)
    times = np.bincount(at, minlength=len(known))
    counts = np.bincount(links, np.repeat(times, groups), len(pairs)).astype(np.int64)
    # each document's pieces once
    mine, how_often = np.unique(np.repeat(np.arange(n), np.diff(bounds)) * max(1, len(known)) + at, return_counts=True)
    ends = pa.array(np.searchsorted(mine, np.arange(n + 1) * max(1, len(known))), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(c, pa.int32())) for c in (mine % max(1, len(known)), how_often)]
    fixed = [pa.array([number] * n, pa.int64()), pa.array([i for i, _ in rows], pa.int64()), *[pa.array(c, pa.int64()) for c in counted]]
    none = [pa.nulls(n, f.type) for f in list(BLOCK_SCHEMA)[-4:]]
    yield pa.RecordBatch.from_arrays([*fixed, pa.array(sha), *lists, *none], schema=BLOCK_SCHEMA)
    own = {"block": number, "links": links, "link_starts": x.groups, "pairs": pairs, "counts": counts}
    yield pa.RecordBatch.from_arrays([pa.array([own.get(f.name)], f.type) for f in BLOCK_SCHEMA], schema=BLOCK_SCHEMA)


def linked_blocks(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Documents and distinct linked pairs with counts, block by block."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part = Vocabularies(tokenizers), TaskContext.get().partitionId() << 32
        for seq, rows in enumerate(held_until(rows_of(batches), BLOCK_CHARS)):
            yield from linked_block(part | seq, rows, v)

    return docs.mapInArrow(linked, BLOCKS)


def counted_pairs(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, at, pair) of every block's pairs, and (pair, n, best) over the corpus: its links, and whether no other A id has more with that B id."""
    entry = F.explode(F.arrays_zip("pairs", "counts", F.sequence(F.lit(0), F.size("pairs") - 1).alias("at")))
    held = blocks.where("size(pairs) > 0").select("block", entry.alias("e")).select("block", "e.at", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n")).where("n > 0")
    totals = held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    totals = materialize(totals, "pairs")
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    return held.drop("n"), totals.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: Tokenizers = Tokenizers()) -> DataFrame:
    """a_id, b_id, n (links that hold the pair) and best over all documents: a table for carrying ids over."""
    counts = counted_pairs(materialize(linked_blocks(_pairs(docs, id_col, text_col), tokenizers), "blocks"))[1]
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    return counts.select(F.shiftright("pair", B_BITS).cast("int").alias("a_id"), b.cast("int").alias("b_id"), "n", "best")


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: Tokenizers = Tokenizers()) -> DataFrame:
    """One row per input row: its groups, links, and how common its links are.

    Null and empty texts, and texts that one tokenizer alters, have no tokens:
    zeros and ''. Special tokens' strings are ordinary text. Every row counts,
    repeated rows and ids too; null ids stay null; texts of any length are
    taken whole; an empty table gives no row; other columns are not looked at.
    """
    blocks = materialize(linked_blocks(_pairs(docs, id_col, text_col), tokenizers), "blocks")
    held, counts = counted_pairs(blocks)
    values = held.join(counts, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    documents = blocks.drop("pairs", "counts")

    def summed(rows: pa.Table, values: pa.Table) -> pa.Table:
        own = rows.filter(pa.compute.is_valid(rows["links"]))
        docs = rows.filter(pa.compute.is_null(rows["links"]))
        links, starts = (own[c].combine_chunks().flatten().to_numpy() for c in ("links", "link_starts"))
        n, best = (np.zeros(links.max(initial=-1) + 1, np.int64) for _ in range(2))
        place = values["at"].to_numpy()
        n[place], best[place] = values["n"].to_numpy(), values["best"].to_numpy()
        lists = docs["at"].combine_chunks()
        bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        at, times = lists.flatten().to_numpy(), docs["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        of_piece = {"n_links": np.diff(starts), "n_best": sums_between(best[links], starts), "count_sum": sums_between(n[links], starts)}
        found = {c: pa.array(sums_between(times * s[at], bounds), pa.int64()) for c, s in of_piece.items()}
        return pa.Table.from_arrays([found[f.name] if f.name in found else docs[f.name] for f in RESULT_SCHEMA], schema=RESULT_SCHEMA)

    return documents.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(summed, RESULT)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents"))
