"""Token shards and packing against the tokenizer library, row by row."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomkb.llm import packing, token_shards
from loomkb.llm.tokens import Encoder
from loomkb.storage import scratch_path

ODD = [
    None,
    "",
    " ",
    "  two  spaces ",
    "tab\tand\nline\r\n end",
    "x" * 3000,
    "a b" * 4000,
    "<|endoftext|> is a token",
    "x  <|startoftext|>  y<|endoftext|>",
    "<|EndOfText|> is none",
    "It's we'll don't CAN'T",
    "Größe été 東京 　wide space é",
    "12345 67 8.9",
    " \n \n x",
    "same text",
    "same text",
    "punctuation!!! ... (a)[b]{c}",
    "a \x1c b\x85c",
]


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_the_whole_text(name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é.\n\t  'sX1") for _ in range(rng.randrange(80))) for _ in range(400)]
    encode, whole = Encoder(name, piece_bytes=4000, word_bytes=2000), tokenizer(name)
    for _ in range(2):
        got = encode(texts)
        for text, ids in zip(texts, got):
            assert np.frombuffer(ids, encode.dtype).tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_shards_round_trip(spark, tmp_path):
    rows = [(3 * i % 17 + (1 << 60), t, "extra") for i, t in enumerate(ODD)] + [(None, "null id", None), (5, "twice", ""), (5, "twice", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = scratch_path(spark, "shards")
    token_shards.write_shards(docs, path, "word_bpe_49k.json", end_id=2)
    got = [tuple(r) for r in token_shards.read_shards(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    whole, want, start = tokenizer("word_bpe_49k.json"), [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_no_rows_give_no_shards(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_path(spark, "shards")
    token_shards.write_shards(empty, path, "word_bpe_49k.json", end_id=2)
    assert token_shards.read_shards(spark, path).count() == 0
    assert packing.pack_documents(empty).count() == 0


def test_keyed_lookup_in_a_shard():
    keys = [None, None, -4, 7, 7, 9] + list(range(100, 3000))
    payloads = [np.arange(i % 5, dtype="<u2").tobytes() for i in range(len(keys))]
    shard = token_shards.Shard(token_shards.write_shard(3, keys, payloads, 2) + b"\n")
    assert shard.lookup(9).tolist() == list(range(0)) and shard.lookup(7, 1).tolist() == [0, 1, 2, 3]
    assert shard.lookup(None, 1).tolist() == [0] and shard.lookup(8) is None and shard.lookup(7, 2) is None
    for i in range(6, len(keys)):
        assert shard.lookup(keys[i]).tobytes() == payloads[i]
    assert sum(shard.lookup(k) is not None for k in range(3000, 8000)) == 0


def check_packing(rows, pieces, window=2048):
    whole = tokenizer("byte_bpe_50k.json")
    ids = {d: whole.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length == len(part) > 0 and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert p.doc_tokens == len(ids[p.doc_id])
    assert by_doc.keys() == ids.keys()
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and all(p.sequence_length == at for p in ps)
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_keeps_every_id_once(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(1000 + i, " ".join(rng.choice(["the", "Größe", "xyzzy", "1"]) for _ in range(rng.randrange(1, 6000)))) for i in range(60)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, offset int").repartition(3)
    assert check_packing(rows, packing.pack_documents(docs).collect()) == 0


def test_packing_in_small_chunks(spark, monkeypatch):
    rows = [(i, "word " * (37 * i % 900)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(packing, "CHUNK_IDS", 3000)
    assert check_packing(rows, packing.pack_documents(docs).collect()) == 0


def test_pack_fills_gaps_with_shorter_pieces_first():
    full, rest = packing.pack([(0, 0, 1500), (1, 0, 548), (2, 0, 5000), (3, 0, 3)])
    assert [(0, 0, 1500), (1, 0, 548)] in full and [(2, 0, 2048)] in full
    assert sum(p[2] for s in full for p in s) + sum(p[2] for p in rest) == 1500 + 548 + 5000 + 3


def test_steps_have_close_costs():
    rng = random.Random(3)
    sequences = [[(0, 0, rng.randrange(1, 2049))] for _ in range(160)]
    steps = packing.steps_of(sequences)
    cost = [sum(s[0][2] ** 2 for s, k in zip(sequences, steps) if k == step) for step in range(10)]
    assert max(steps) == 9 and max(cost) < 1.2 * min(cost)


def test_index_leads_from_keys_to_shards(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD_IDS", 200)
    rows = [(7 * i, f"text number {i} " * (i % 9)) for i in range(300)] + [(None, "null"), (7, "again"), (7, "again")]
    path = scratch_path(spark, "tokens")
    token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, "word_bpe_49k.json", end_id=2)
    token_shards.write_index(spark, path, keys_per_bucket=60)
    asked = spark.createDataFrame([(k,) for k in [*range(0, 2400, 3), None, -1, 0, 0]], "doc_id long")
    got = {r.doc_id: r.ids for r in token_shards.lookup(spark, path, asked).collect()}
    whole, texts = tokenizer("word_bpe_49k.json"), dict(rows[:300])
    assert got == {k: whole.encode(texts[k], add_special_tokens=False).ids + [2] for k in range(0, 2100, 21)}


def test_rows_of_one_id_spread_over_shards(spark):
    rows = [(5, f"text {i}") for i in range(400)] + [(9, "same")] * 400
    path = scratch_path(spark, "tokens")
    token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, "word_bpe_49k.json", end_id=2)
    got = token_shards.read_shards(spark, path).collect()
    assert len(got) == 800 and len({r.shard for r in got}) > 2
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.doc_id == (5 if r.start < sum(x.n_tokens for x in got if x.doc_id == 5) else 9)
        at += r.n_tokens


def tiers_only(rng, n=300):
    return [(i, 0, rng.choice([rng.randrange(1, 60), rng.randrange(1, 700), rng.randrange(1, 5000)])) for i in range(n)]


@pytest.mark.parametrize("tiers", [(2048, 1024, 512, 256), (2048, 512), (2048,), (64, 16)])
def test_windows_are_as_long_as_their_tiers(tiers):
    rng = random.Random(11)
    for _ in range(20):
        pieces = tiers_only(rng)
        full, rest = packing.pack(pieces, tiers)
        assert {sum(p[2] for p in s) for s in full} <= set(tiers) and sum(p[2] for p in rest) < tiers[0]
        got = sorted(p for s in [*full, rest] for p in s)
        for doc, _, n in pieces:
            at = 0
            for d, start, k in (p for p in got if p[0] == doc):
                assert start == at
                at += k
            assert at == n


def test_tiers_decide_where_documents_go():
    rng = random.Random(12)
    pieces = [(i, 0, rng.randrange(10, 240)) for i in range(400)] + [(400 + i, 0, rng.randrange(1100, 2000)) for i in range(20)]
    several, _ = packing.pack(pieces, (2048, 1024, 512, 256))
    one, _ = packing.pack(pieces, (2048,))
    assert {sum(p[2] for p in s) for s in one} == {2048}
    assert sum(sum(p[2] for p in s) == 256 for s in several) > 50
    # a short document is in a short window, or fills the gap of a long one
    assert all(any(p[0] >= 400 for p in s) for s in several if sum(p[2] for p in s) == 2048)


def test_steps_share_out_the_context_sizes():
    rng = random.Random(13)
    full, _ = packing.pack(tiers_only(rng, 3000))
    steps = packing.steps_of(full)
    by_step = {}
    for s, k in zip(full, steps):
        by_step.setdefault(k, []).append(sum(p[2] for p in s))
    assert sorted(by_step) == list(range(max(steps) + 1)) and max(map(len, by_step.values())) <= packing.STEP
    for tier in packing.TIERS:
        counts = [sizes.count(tier) for sizes in by_step.values()]
        assert max(counts) - min(counts) <= 2
    ids = [sum(sizes) for sizes in by_step.values()]
    assert max(ids) < 1.2 * min(ids)


def test_packing_of_nothing_and_of_repeated_ids(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "one two three"), (1, "one two three"), (1, ""), (None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    total = len(tokenizer("byte_bpe_50k.json").encode("one two three", add_special_tokens=False).ids) + 1
    assert sum(p.length for p in got if p.doc_id == 1) == 2 * total + 1 and sum(p.length for p in got if p.doc_id is None) == 1
