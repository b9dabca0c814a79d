"""Registered queries against brute force on whole small tables: nothing is left out by a filter."""

import datetime as dt
import re
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkb.functions import text
from loomkb.operators import evidence, joins
from loomkb.plans import registry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def related_by_brute_force(docs, top=5):
    """(l, r, score) over all ordered pairs of (id, text)."""
    stop = set(text.STEM_STOP)
    stems = {i: {w[:6] for w in re.findall("[a-zа-яё]{4,}", t.lower()) if w not in stop} for i, t in docs}
    best = {}
    for l, r in permutations(stems, 2):
        if stems[l] and stems[r]:
            score = round(len(stems[l] & stems[r]) / (len(stems[l]) * len(stems[r])) ** 0.5, 9)
            if score >= evidence.ISSUE_MIN:
                best.setdefault(l, []).append((-score, r))
    return sorted((l, r, -s) for l, found in best.items() for s, r in sorted(found)[:top])


@pytest.mark.parametrize("block", [evidence.BLOCK, 7])
def test_related_score_covers_all_sources(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(evidence, "BLOCK", block)
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}word"[:6] for a in "abcdefgh" for b in "klmn" for c in "xyz"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 25))), f"src{i % 4}") for i in range(60)]
    docs += [(60 + i, docs[3][1], f"src{i % 5}") for i in range(8)] + [(70, "и в на", "src0"), (71, "", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(registry.queries()["related_score"](spark, str(tmp_path)).select("l_id", "r_id", "score"))
    want = related_by_brute_force([d[:2] for d in docs])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want], abs=1e-9) and len({l for l, *_ in got}) > 50


def test_related_texts_write_each_set_once_whatever_the_number_of_blocks(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(evidence, "materialize", lambda df, name, write=evidence.materialize: kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(evidence, "BLOCK", 7)
    docs = [(i, f"alpha beta{'cdefgh'[i % 6]} gamma{'klmnop'[i // 6 % 6]} delta{'qrst'[i // 36]}") for i in range(100)]
    docs += [(100 + i, t) for i, t in docs]
    df = spark.createDataFrame(docs, "id long, body string")
    found = evidence.related_texts(evidence.described(df, F.col("body")), "id", evidence.ISSUE_MIN)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search("CartesianProduct|NestedLoopJoin", plan) and "FlatMapGroups" not in plan  # blocks meet without a shuffle of their sets
    blocks = kept["blocks"].select(F.size("reps").alias("n"), F.size("codes").alias("codes")).collect()
    assert len(blocks) > 9 and sum(b["n"] for b in blocks) == 100 and sum(b["codes"] for b in blocks) == 400
    got = rows(found.select("l_id", "r_id", "score"))
    assert [g[:2] for g in got] == [w[:2] for w in related_by_brute_force(docs)]


def titles_by_brute_force(parts):
    """(a, b, score) over all pairs of (id, name, kind)."""
    out = []
    for (a, x, k), (b, y, m) in combinations(sorted(parts), 2):
        s, t = ({w[:6] for w in re.findall("[a-zа-яё]+", n.lower()) if len(w) > 1 and w not in text.TITLE_STOP} for n in (x, y))
        score = round(len(s & t) / min(len(s), len(t)) * (1.0 if k == m else 0.8), 9) if s and t else 0.0
        out += [(a, b, score)] * (score >= 0.75)
    return out


def test_title_overlap_meets_across_brands(spark, tmp_path):
    words = ["red", "hot", "blue", "plate", "ring", "widget", "anvil"]
    rng = np.random.default_rng(7)
    parts = [(i, " ".join(rng.choice(words, rng.integers(1, 6))), f"Brand#{i % 3}") for i in range(80)] + [(90, "v 2", "Brand#1"), (91, "", "Brand#1")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    p = spark.read.parquet(f"{tmp_path}/part.parquet").select("p_partkey", text.title_stems(F.col("p_name")).alias("s"), "p_brand")
    got = rows(joins.title_pairs(p, "p_partkey", "s", "p_brand"))
    assert got == titles_by_brute_force(parts)
    links = Counter(i for a, b, _ in got for i in (a, b))
    assert rows(registry.queries()["title_overlap"](spark, str(tmp_path)).select("p_partkey", "n_links")) == [(i, links[i]) for i in range(80)]
    assert {s for a, b, s in got if a % 3 != b % 3} == {0.8} and 0.75 in {s for *_, s in got}


def test_cross_join_keeps_every_order(spark, tmp_path):
    orders = [(i, 10.0 * i) for i in range(1, 24)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(registry.queries()["join_cross_one_row"](spark, str(tmp_path)).select("o_orderkey", "ratio"))
    mean = sum(price for _, price in orders) / len(orders)
    assert got == [(i, round(price / mean, 6)) for i, price in orders]


def test_threads_merge_on_whole_letters_only(spark, tmp_path):
    same, hello = "Добрый день, коллеги! Отчёт готов.", "Hello everyone, here is "
    letters = [(1, hello + "the plan"), (2, hello + "the bill"), (2, "Second letter"), (3, same), (4, "Own"), (4, "> добрый день, коллеги!\n> отчёт готов."), (5, "Own too"), (5, "second  LETTER"), (5, same)]
    letters += [(6, "..."), (7, "..."), (8, ""), (9, ""), (10, None)]
    spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(letters)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = dict(rows(registry.queries()["thread_merge"](spark, str(tmp_path)).select("conv_id", "thread_id")))
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2} | {i: i for i in range(6, 11)}


def test_eval_recall_finds_passages_wherever_they_begin(spark, tmp_path):
    docs = ["Il va à l'école «publique» de la ville.", "Some ordinary words, and nothing more?!", "плохо...   ёлка"]
    inside = ["L'école publique de", "cole publique de la vi", "rdinary words, and noth", "?!", "dinar", "y wor", "... елк", "ordinary words and"[:14]]
    missing = ["ordinary words and", "école privée de la", "!?", "zzz"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(inside + missing + ["", "«»"])), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["eval_recall"](spark, str(tmp_path)).first()
    assert (got["items"], got["found"], got["recall"]) == (12, 8, 0.667)


def test_cards_order_events_by_line_first_whatever_the_size_of_keys(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    lines = [(1, 3_000_000, 5, 1, 11.0, "R", "O", day), (1, 4, 2_000_000, 2, 12.0, "R", "O", day), (1, 4, 5, 2, 13.0, "R", "F", day), (1, 5, 1, 2, 14.0, "R", "F", day)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, "O", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "Ann", "FOOD")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert registry.queries()["issue_cards"](spark, str(tmp_path)).first()["first_event"] == "11"
    said = registry.queries()["issue_short_cards"](spark, str(tmp_path)).first()["comments"]
    assert [c.split(": ")[1] for c in said.split("|")] == ["11", "13", "12", "14"]


def test_containment_is_exact_in_small_buckets_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "COMPARED", 3)
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(list("abcde"), rng.integers(0, 9))) for _ in range(60)]
    long = [" ".join(f"w{i}x{k}" for i in range(40)) for k in range(3)]
    texts += [t + f" tail{i}" for t in long for i in range(9)] + [texts[3]] * 5 + [None, "", "?!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [re.findall(r"\w+", t or "") for t in texts]
    sets = [{" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set() for w in words]
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) >= 0.75}
    links = Counter(i for p in want for i in p)
    first = {tuple(w): i for i, w in reversed(list(enumerate(words)))}
    rep = [first[tuple(w)] for w in words]
    assert {p[:2] for p in rows(joins.containment_pairs(spark.read.parquet(f"{tmp_path}/documents.parquet")))} == want
    got = rows(registry.queries()["near_dup_containment"](spark, str(tmp_path)).select("doc_id", "rep", "n_links"))
    assert got == [(i, rep[i], links[i]) for i in range(len(texts))]
    hashed = [(i, [h % 97 for h in map(hash, s)]) for i, s in enumerate(sets) if s and rep[i] == i]
    few = spark.createDataFrame([(i, sorted(set(s))) for i, s in hashed], "rep long, s array<long>")
    expect = sorted((a, b) for a, b in combinations(dict(hashed), 2) if len(set(dict(hashed)[a]) & set(dict(hashed)[b])) / min(len(set(dict(hashed)[a])), len(set(dict(hashed)[b]))) >= 0.75)
    for counted in (1 << 20, 40):
        monkeypatch.setattr(joins, "COUNTED", counted)
        assert sorted((min(r[:2]), max(r[:2])) for r in joins.contained_sets(few, 0.75).collect()) == expect


def test_elements_take_as_many_bytes_among_many_buckets_as_among_few(spark):
    rng = np.random.default_rng(3)
    held = [(i, [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)]) for i in range(400)]
    sets = spark.createDataFrame(held, "rep long, items array<long>").coalesce(1)
    for buckets in (1, 128):
        dealt = sets.mapInArrow(joins._dealt(buckets, 0), joins._PACKED)
        rows, size, elements = dealt.agg(F.count("*"), F.sum(F.length("places") + F.length("codes") + 80), F.sum(F.when(F.col("bucket") >= 0, F.col("n")))).first()
        assert rows == buckets + 1 and elements == 400 * 300 and size < 7 * elements


@pytest.mark.parametrize("marked", [1, 1 << 17])
def test_copies_are_one_document_whatever_passes_the_filter_of_ids(spark, tmp_path, monkeypatch, marked):
    monkeypatch.setattr(joins, "MARKED", marked)
    monkeypatch.setattr(joins, "DEALT", 50)
    docs = [(i, f"one two three four{i % 40} five{i % 40} six seven eight nine ten") for i in range(120)] + [(200, "two three"), (201, "Two, three!"), (202, "three two")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    _, members = joins.containment_classes(df)
    keyed = joins.materialize(joins._worded(df, "doc_id", "text"), "keys")
    assert rows(joins._reps(df, keyed, "doc_id", "text").select("rep")) == sorted({(r["rep"],) for r in members.collect()})
    found = joins.containment_reps(df, threshold=0.5).collect()
    assert sorted((min(r[:2]), max(r[:2]), r["score"]) for r in found) == [(a, b, 0.5) for a, b in combinations(range(40), 2)]


def test_members_are_named_without_words_being_written(spark, tmp_path, monkeypatch):
    written = []
    plain = joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name="table": written.append(df.columns) or plain(df, name))
    spark.createDataFrame([(1, "A b"), (2, "a, b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(registry.queries()["near_dup_members"](spark, str(tmp_path)).select("id", "rep", "worded")) == [(1, 1, True), (2, 1, True), (3, 3, False)]
    assert written == [["id", "key", "worded"]]


def test_contours_are_scored_before_rows_are_shuffled(spark):
    contours = spark.createDataFrame([(1, "system", "Alpha Beta", None, ["alfa"]), (2, "subsystem", "Gamma", 1, None)], "id long, kind string, name string, parent_id long, aliases array<string>")
    texts = spark.createDataFrame([(7, "alpha beta and gamma", []), (8, "galaxy", [])], "id long, t string, o array<string>")
    scores = evidence.contour_scores(texts, contours, "id", "t", "o")
    assert {(r["id"], r["contour_id"]) for r in scores.collect()} == {(7, 1), (7, 2)}
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "words" in line]
