"""Line dedup, fill-in-middle and token alignment against brute force, with odd rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomkb.llm import fill_middle, line_dedup, token_alignment
from loomkb.llm.tokens import byte_letters
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# line dedup

LONG = "a line that is long enough to be counted"
MIXED = "  \t" + LONG.upper() + " \x0b\x0c\r"


def brute_lines(rows, min_docs, min_chars, keep):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc_id, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(doc_id)
    out = []
    for doc_id, text in rows:
        lines, left = (text or "").split("\n"), []
        for line in lines:
            ids = holders.get(key(line), [])
            named = [i for i in ids if i is not None]
            if len(ids) < min_docs or doc_id == (keep(named) if named else None):
                left.append(line)
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("settings", [line_dedup.Settings(), line_dedup.Settings(min_docs=2, min_chars=3, keep="min"), line_dedup.Settings(min_docs=1, min_chars=0)])
@pytest.mark.parametrize("block_lines", [3, 1 << 17])
def test_lines(spark, monkeypatch, settings, block_lines):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block_lines)
    rng = random.Random(4)
    stock = [LONG, MIXED, "short", "", " ", "ä" * 20, "ä" * 19, "Ä" * 20, "x" * 19, "x" * 20, "tail\r", LONG + "\x1e", " " + LONG]
    rows = [(rng.randrange(-5, 40), "\n".join(rng.choice(stock) for _ in range(rng.randrange(6)))) for _ in range(80)]
    rows += [(None, LONG), (7, None), (7, ""), (99, "\n\n" + LONG + "\n"), (99, MIXED), (99, MIXED), (None, "y" * 300_000), (5, "only nameless"), (1 << 62, (LONG + "\n") * 3)]
    rows += [(None, "held by rows without an id alone")] * 3
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n_lines string, shard int").repartition(3)
    got = line_dedup.dedup_lines(docs, settings=settings)
    assert got.columns == ["doc_id", "text", "shard", "n_lines", "n_dropped"]
    found = [tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert ordered(found) == ordered(brute_lines(rows, settings.min_docs, settings.min_chars, max if settings.keep == "max" else min))


def test_lines_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).count() == 0


def test_line_index_counts_every_line_and_no_other():
    rng = np.random.default_rng(1)
    pairs = rng.integers(-(1 << 63), 1 << 63, (5000, 2))
    pairs[1:50, 0] = pairs[0, 0]  # halves may repeat
    pairs[50:60, 1] = pairs[0, 1]
    n, keepers = rng.integers(1, 300, 5000), rng.integers(-9, 9, 5000)
    index = line_dedup.LineIndex(line_dedup.LineIndex.build(pairs[:, 0], pairs[:, 1], n, keepers, keepers == 0, 250))
    counts, slots = index.probe(pairs[:, 0], pairs[:, 1])
    assert counts.tolist() == n.tolist() and sorted(slots) == list(range(5000)) and index.counts.dtype.itemsize == 2
    hot = n >= 250
    ids, nameless = index.keeper(slots[hot], 250)
    assert ids.tolist() == keepers[hot].tolist() and nameless.tolist() == (keepers[hot] == 0).tolist()
    others = rng.integers(-(1 << 63), 1 << 63, (5000, 2))
    assert index.probe(others[:, 0], others[:, 1])[0].sum() == 0


# fill in the middle


def brute_middle(doc_id, text, rate=100, spm=50):
    raw = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", raw)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if raw == "" or any(m in raw for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, raw
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 50)])
def test_middle(spark, rate, spm):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "\n", "\x1e", "\x1f", "0", "1", "<", "P>", "é", "\U0001f600", "\r", "$0", "\\"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", "\n", "\n\n", "x<P>y", "<M", "<<S", "x" * 200_000, "l\n" * 50_000, "same\ntext", "same\ntext"]
    rows = [(i - 5, t, "clash", "p") for i, t in enumerate(texts)] + [(None, "no\nid\n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, __p string")
    settings = fill_middle.Settings(rate=rate, spm_rate=spm)
    got = fill_middle.fill_in_middle(docs, settings=settings)
    assert got.columns == ["doc_id", "text", "__p", "n", "form", "prefix", "middle", "suffix", "output"]
    got = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), settings))
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for doc_id, text, *_ in rows:
        r = found[doc_id]
        assert (r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) == brute_middle(doc_id, text, rate, spm)
        assert r["back"] == (text or "")


def test_middle_of_other_units_and_markers(spark):
    docs = spark.createDataFrame([(i, "One. Two\x1f three. Four") for i in range(40)], "doc_id long, text string")
    settings = fill_middle.Settings(unit=r"[^.]*\.|[^.]+", prefix="<a>", suffix="<b>", middle="<c>")
    got = fill_middle.fill_in_middle(docs, settings=settings).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), settings))
    for r in got.collect():
        assert r["n"] == 3 and r["back"] == r["text"] == r["prefix"] + r["middle"] + r["suffix"]
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0
    for bad in ("P", "<P", "<<P>"):
        with pytest.raises(ValueError):
            fill_middle.Settings(prefix=bad)


# alignment


def brute_links(rows):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codes = {letter: b for b, letter in byte_letters().items()}

    def ends(tokens):
        return np.cumsum([len(t) for t in tokens]).tolist()

    each, counts = [], Counter()
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        a_bytes = [bytes(codes[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            each.append((doc_id, [], [], [], []))
            continue
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        links = [(x, y) for x, e in zip(a, a_ends) for y in [dict(zip(b_ends, b)).get(e)] if y is not None] if len(a) < 500 else None
        both = sorted(set(a_ends) & set(b_ends))
        if links is None:
            of_a, of_b = dict(zip(a_ends, a)), dict(zip(b_ends, b))
            links = [(of_a[e], of_b[e]) for e in both]
        groups, i, j = [], 0, 0
        for e in both:
            k, m = a_ends.index(e) + 1, b_ends.index(e) + 1
            groups.append((a[i:k], b[j:m], e))
            i, j = k, m
        counts.update(links)
        each.append((doc_id, a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out, all_groups = [], []
    for doc_id, a, b, groups, links in each:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha(text) if a else ""))
        all_groups.append((doc_id, groups))
    return out, all_groups, counts, best


ODD = [
    None, "", " ", "  ", "   x", "x  ", "a  b   c", "tab\tand\nline\r\n end", "<|endoftext|> is text", "<s> </s> <unk> <0x0A>", "▁", "a ▁ b", "a▁",
    "Größe été 東京 　wide", "é Å ﬁ", "\U0001f600\U0001f600 ok", "a\x00b \x01", "12345 67 8.9", "same text", "same text", "x" * 3000, "a b " * 3000, "﻿mark", "\xa0 \x85",
]


@pytest.mark.parametrize("block_chars", [40, 8 << 20])
def test_alignment(spark, monkeypatch, block_chars):
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", block_chars)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["ab", " ", "  ", "é", ".", "\n", "The", "▁", "東", "7", " of"]) for _ in range(rng.randrange(40))) for _ in range(100)]
    rows = [(i + (1 << 60), t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, block string, n_a int").repartition(3)
    want, groups, counts, best = brute_links(rows)
    assert ordered([tuple(r) for r in token_alignment.token_links(docs).collect()]) == ordered(want)
    if block_chars == 40:
        return
    found = [(r["doc_id"], [(g["a"], g["b"], g["end"]) for g in r["groups"]]) for r in token_alignment.aligned_groups(docs).collect()]
    assert sorted(found, key=str) == sorted(groups, key=str)
    pairs = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in token_alignment.link_counts(docs).collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def test_alignment_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.token_links(docs).count() == 0


def test_pieces_give_the_ids_of_the_whole_text():
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rng.choice(["a", " ", "  ", "é.", "\n", "\t", "The", "東", "　", "\U0001f600"]) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts = [t for t in texts if "▁" not in t]
    v = token_alignment.Vocabularies(token_alignment.Tokenizers())
    assert v.cuts
    whole = v.tokens(texts)
    cut = v.tokens([p for t in texts for p in v.pieces(t)])
    assert whole.a.tolist() == cut.a.tolist() and whole.b.tolist() == cut.b.tolist()
    assert whole.b.tolist() == [i for t in texts for i in v.model.encode(t)]
