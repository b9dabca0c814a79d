"""Operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest

from loomkb.llm import bloom, embedding_dedup, exact_dedup, html_extract, mixing, ngram_join, toxicity, url_filter, warc
from loomkb.operators.components import connected_components
from loomkb.storage import scratch_path

UPPER = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# components


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs_and_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    path = list(range(1000, 1100))
    rng.shuffle(path)
    edges += list(zip(path, path[1:])) + [(5000, i) for i in range(5001, 5050)] + [(7, 7), (None, 3)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == closure({n for e in real for n in e}, real)


# exact dedup

TEXTS = [None, "", "A", "a", "É", "é", "x" * 200_000, "X" * 200_000, "two words", "two  words", "A\n", "a"]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, keep):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "a", "same row again"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    got = rows_of(exact_dedup.exact_dedup(docs, keep=keep), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want, groups = [], {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    for i, t, _ in rows:
        norm = (t or "").translate(UPPER)
        best = (max if keep == "max" else min)(x for x in groups[norm] if x is not None)
        want.append((i, best, len(groups[norm]), i == best, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = exact_dedup.keep_distinct(docs.where("doc_id IS NOT NULL AND keep_id = 'clash'"), keep=keep)
    assert kept.columns == docs.columns and kept.count() == len({(t or "").translate(UPPER) for t in TEXTS})


def test_one_row_of_each_text_stays(spark):
    docs = spark.createDataFrame(
        [(1, "x", "a"), (2, "X", "b"), (1, "y", "c"), (3, "z", "d"), (3, "z", "c"), (3, "z", "c"), (None, None, "e"), (None, "", "e"), (4, "", None)],
        "doc_id long, text string, __t string",
    )
    got = sorted(rows_of(exact_dedup.keep_distinct(docs), "doc_id", "text", "__t"))
    assert got == [(1, "y", "c"), (2, "X", "b"), (3, "z", "c"), (4, "", None)]
    assert exact_dedup.keep_distinct(docs.limit(0)).columns == docs.columns


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# url filter


def brute_verdict(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group().translate(UPPER)
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.host + r.path), r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.action if best else "allow"


URLS = [
    None,
    "",
    "no scheme/en/",
    "http://COM/en/x",
    "http://a.com/en/7",
    "https://m.Example.COM/en/77?q#f",
    "https://notexample.com/en/7",
    "https://x.net/de/8",
    "https://example.net/de/8#x",
    "http://org?/es/",
    "http://.org/es/",
    "http://org./es/",
    "ftp://b.org/es/" + "y" * 5000,
    "http://u:p@c.com:80/en/",
    "http://example.com/EN/7",
    "a://b://com/en/",
]


@pytest.mark.parametrize("passing", [bloom.PASSING, 1])
def test_url_rules(spark, monkeypatch, passing):
    monkeypatch.setattr(bloom, "PASSING", passing)
    rng = random.Random(5)
    names = ["com", "example.com", "net", "a.b.c.net", "x.org"]
    rules = list(url_filter.RULES) + [url_filter.Rule(rng.choice(["block", "allow"]), rng.choice(names), f"/p{i}/") for i in range(200)]
    urls = URLS + [f"http://{rng.choice(['', 'w.', 'b.c.'])}{rng.choice(names)}/p{rng.randrange(300)}/{i}" for i in range(2000)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    actions = {}
    for r in rules:
        actions.setdefault(r.host + r.path, r)
    got = rows_of(url_filter.judge_urls(pages, rules), "page_id", "host", "path", "rule", "verdict")
    assert sorted(got) == [(i, *brute_verdict(u, list(actions.values()))) for i, u in enumerate(urls)]


def test_many_shapes_of_rules_in_one_plan(spark, monkeypatch):
    """A table of 20,000 rules of 200 shapes, judged and then filtered, in shards of few words."""
    monkeypatch.setattr(bloom, "SHARD_WORDS", 1 << 12)
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "net", "x.y.z.net"]
    rules = {}
    for i in range(20_000):
        r = url_filter.Rule("block" if i % 3 else "allow", rng.choice(hosts), "/" + f"{i % 500:03d}" * (i % 40) + "x" * (i % 5))
        rules.setdefault(r.host + r.path, r)
    table = spark.createDataFrame([(r.action, r.host, r.path, "extra") for r in rules.values()] + [(None, "com", "/", ""), ("block", None, "/", ""), ("zzz", "com", next(r for r in rules.values() if r.host == "com").path, "")], "action string, host string, path string, more string")
    urls = [f"http://{rng.choice(['', 'w.'])}{rng.choice(hosts)}/{f'{rng.randrange(500):03d}' * rng.randrange(42)}{'x' * rng.randrange(6)}" for _ in range(300)]
    urls += [None, "", "http://" + "a." * 3000 + "com/000", "http://com/" + "000" * 100_000] + urls[:5]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    judged = url_filter.judge_urls(pages, table)
    want = [(i, *brute_verdict(u, list(rules.values()))) for i, u in enumerate(urls)]
    assert sorted(rows_of(judged, "page_id", "host", "path", "rule", "verdict")) == want
    start = time.time()
    assert judged.where("rule IS NOT NULL").count() == sum(w[3] is not None for w in want)
    assert time.time() - start < 60


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = universe.where("crc32(key) % 7 = 0")
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(universe["key"])).exceptAll(listed).count() == 0
    assert listed.where(~cascade.contains(listed["key"])).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "url string"), url_filter.RULES).count() == 0


def test_false_positives_shrink_from_level_to_level(spark):
    universe = spark.range(300_000).selectExpr("concat('u', id) AS key")
    listed = universe.where("substr(key, 2) IN ('7', '70', '700')")
    cascade = url_filter.Cascade(listed, universe)
    assert sum(level.size for level in cascade.levels) <= 40
    assert sorted(r[0] for r in universe.where(cascade.contains(universe["key"])).collect()) == ["u7", "u70", "u700"]


# mixing


def brute_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else share[s] for s in sizes}
        full |= over


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 5, 60, 400, rng.randrange(900)]), rng.choice("aaaaaabcdefZ") + rng.choice(["", "é"])) for i in range(3000)]
    rows += [(9001, None, None), (9002, "a\u00a0b c\x0bd\x1ce", None), (9003, "", "empty"), (9003, "", "empty"), (9004, "x " * 120_000, "b")]
    rows += [(9005, "only", "tiny"), (None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken", "copies")
    again = rows_of(mixing.mix(docs.repartition(7)), "doc_id", "size", "source_size", "target", "taken", "copies")
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, by_source = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets, source_of = brute_targets(sizes), {i: s for i, _, s in rows}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for i, size, source_size, target, taken, copies in got:
        s = source_of[i]
        assert taken == copies * size <= 3 * size and source_size == sizes[s] and target == pytest.approx(targets[s], rel=1e-9)
        by_source[s] = by_source.get(s, 0) + taken
    for s, taken in by_source.items():
        assert abs(taken - targets[s]) <= max(0.01 * targets[s], 3)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[5] for r in got)
    rates = [sorted(rows_of(mixing.mix(docs.repartition(n)), "doc_id", "size", "rate", "taken"), key=str) for n in (3, 7, 16)]
    assert rates[0] == rates[1] == rates[2]


def test_mixing_of_repeated_ids_and_rows(spark):
    rows = [(None, f"text {i} " * (i % 7), "a") for i in range(600)] + [(1, "the same words", "b")] * 3000 + [(2, "other words here", "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken", "copies")
    assert len(got) == len(rows) and all(r[4] == r[5] * r[1] <= 3 * r[1] for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault((r[2], r[3]), []).append(r[4])
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= max(0.01 * target, 7)
    mixed = mixing.mixed_documents(docs)
    assert mixed.count() == sum(r[5] for r in got) and mixed.columns == docs.columns


def test_mixing_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    with pytest.raises(ArithmeticError, match="after 1 steps"):
        mixing.mixed_documents(docs).collect()


def test_mixing_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], empty.schema)
    assert rows_of(mixing.mix(blank).orderBy("doc_id"), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# embeddings


@pytest.mark.parametrize("block", [40, 2048])
def test_embedding_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(7)
    vectors = []
    for label in (0, 1, None):
        for spread in (0.001, 0.05, 0.1, 0.14, 0.2, 3.0):
            center = rng.normal(size=24)
            center /= np.linalg.norm(center)
            vectors += [(label, (3.0 * (center + spread * rng.normal(size=24) / np.sqrt(24))).astype(np.float32).tolist()) for _ in range(40)]
    vectors += [(0, vectors[0][1])] * 30 + [(1, vectors[0][1]), (0, [0.0] * 24), (0, None), (0, [float("nan")] * 24), (0, [float("inf")] + [1.0] * 23)]
    vectors += [(0, [1.0, None]), (0, [1.0]), (0, [2.0]), (0, []), (0, [-1.0])]
    rng.shuffle(vectors)
    rows = [(i, v, label, "x") for i, (label, v) in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = {r[0]: r[1:] for r in rows_of(embedding_dedup.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")}

    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, np.float64), label) for i, v, label, _ in rows if usable(v, label)]
    links = []
    for k, (i, a, x) in enumerate(ok):
        for j, b, y in ok[:k]:
            if x == y and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links.append((i, j))
    counts = {i: 0 for i, *_ in rows}
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    reached = closure(counts, links)
    assert len(links) > 2000
    assert got == {i: (counts[i], reached[i], reached[i] == i) for i in counts}


def test_ids_that_name_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]), (5, [0.7, -0.7])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<float>, label string")
    got = sorted(rows_of(embedding_dedup.near_duplicates(df), "vec_id", "n_links", "component_id", "kept"))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True)]
    # another vector of id 4 draws its copies to the smaller id that it links with
    more = df.union(spark.createDataFrame([(4, [0.0, 2.0], "a")], df.schema))
    got = sorted(rows_of(embedding_dedup.near_duplicates(more), "vec_id", "n_links", "component_id"))
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 1, 1), (4, 1, 1), (4, 2, 1), (5, 0, 5)]


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# n-gram join


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("n,threshold,block,tree,hot", [(4, (85, 100), 256, 4096, 8), (5, (80, 100), 12, 16, 0.5)])
def test_jaccard_components(spark, monkeypatch, n, threshold, block, tree, hot):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TREE", tree)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "One  Two", "two one", "a b c d", "A B C D", "a b c d e", "\u00a0 x", "É é", "é É"]
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        texts += [edited(rng, base, k) for k in (0, 0, 1, 1, 2, 3, 4, 6)]
    base = [f"h{i}" for i in range(150)]
    texts += [edited(rng, base, rng.randrange(3)) for _ in range(60)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(90))) + " " + passage for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(None, "one two", "x"), (3, texts[1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(rows_of(ngram_join.jaccard_components(docs, n, threshold), "doc_id", "n_shingles", "component_id"), key=str)
    sets = {i: shingle_set(t, n) for i, t, _ in rows if i is not None}
    ids = [i for i in sets if sets[i]]
    num, den = threshold
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[:k]
        if den * (both := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - both)
    ]
    reached = closure(sets, links)
    want = [(i, len(shingle_set(t, n)), None if i is None else reached[i]) for i, t, _ in rows]
    assert len(links) > 60
    assert got == sorted(want, key=str)
    kept = ngram_join.keep_one_of_each(docs.where("component_id = 'x'"), n, threshold)
    assert kept.columns == docs.columns and kept.where("doc_id IS NOT NULL").count() == len(set(reached.values()))


def test_rtree_bounds_lose_no_pair():
    rng = np.random.default_rng(9)
    for k in (1, 2, 17, 300):
        points = rng.poisson(2.0, (k, 8))
        points[k // 2 :] = np.maximum(0, points[: k - k // 2] + rng.integers(0, 2, (k - k // 2, 8)))
        sizes = points.sum(axis=1)
        got = {tuple(sorted((i, int(j)))) for i, js in ngram_join.RTree(points, sizes).self_join(8, 10) for j in js}
        for i in range(k):
            for j in range(i):
                total, both = sizes[i] + sizes[j], np.minimum(points[i], points[j]).sum()
                if 18 * both >= 8 * total and 10 * min(sizes[i], sizes[j]) >= 8 * max(sizes[i], sizes[j]):
                    assert (j, i) in got


def test_no_documents_to_join(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty).count() == 0


# toxicity


def test_pairs_of_terms_are_learnt():
    """Neither the insult nor the group is toxic by itself."""
    rng, terms = random.Random(10), toxicity.Terms(18)
    rows = []
    for i in range(1200):
        words = [f"n{rng.randrange(60)}" for _ in range(12)] + (["qqinsult"] if i % 2 else []) + (["zzgroup"] if i // 2 % 2 else [])
        rows.append((terms(" ".join(words)), int(i % 4 == 3)))
    model = toxicity.fit(rows, toxicity.Settings(bits=18, epochs=30))
    score = lambda t: model.score(terms(t))
    assert score("n1 n2 qqinsult zzgroup") > 0.5 > max(score("n1 n2 qqinsult"), score("n1 n2 zzgroup"), score("n1 n2"))


def test_terms_that_only_act_in_pairs_are_learnt():
    """Exactly one of two terms makes a text toxic; neither says anything by itself."""
    rng, terms = random.Random(4), toxicity.Terms(20)
    rows = []
    for _ in range(4000):
        words = [f"w{rng.randrange(800)}" for _ in range(30)]
        one, other = rng.random() < 0.5, rng.random() < 0.5
        words += ["alphaword"] * one + ["betaword"] * other
        rows.append((terms(" ".join(words)), int(one != other)))
    model = toxicity.fit(rows[:3000], toxicity.Settings())
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in rows[3000:]]) > 0.95


def test_scores_are_those_of_the_formula():
    rng = np.random.default_rng(6)
    rows = [(np.unique(rng.integers(0, 300, 40)).astype("<i4"), int(rng.random() < 0.3)) for _ in range(400)]
    model = toxicity.fit(rows, toxicity.Settings(bits=9))
    place = {int(t): i for i, t in enumerate(model.index)}
    for terms, _ in rows[:40]:
        at = [place[int(t)] for t in terms if int(t) in place]
        z = model.bias + sum(float(model.weights[i]) for i in at)
        z += sum(float(model.factors[i].astype(float) @ model.factors[j].astype(float)) for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(model.score(terms) - 1 / (1 + np.exp(-z))) < 1e-4


def test_toxicity_sample_is_bounded_in_bytes_and_repeats_teach_once(spark):
    docs = [(i, f"word{i} " * 3 + ("idiot" if i % 2 else "kind")) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    once, repeated = (spark.createDataFrame(d, "doc_id long, text string") for d in (docs, docs * 3))
    a, b = toxicity.train(once, labels), toxicity.train(repeated, labels)
    assert a.bias == b.bias and (a.index == b.index).all() and (a.weights == b.weights).all()
    few = toxicity.train(once, labels, toxicity.Settings(sample_bytes=20))
    assert len(few.index) == 0
    scored = toxicity.score_texts(repeated.limit(0), a)
    assert scored.count() == 0 and scored.columns == ["doc_id", "held_out", "score", "predicted"]


def test_toxicity_on_tables(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = [f"n{rng.randrange(500)}" for _ in range(30)] + (["idiotic", "SCUM"] if toxic else [])
        docs.append((i, " ".join(words), "score"))
        labels += [(i, int(toxic))] * (i % 4 > 0)
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "scum idiots", "x"), (5002, "n " * 300_000, "x")]
    labels += [(None, 1), (4, None), (77777, 1)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.train(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = rows_of(toxicity.score_texts(documents, model), "doc_id", "held_out", "score", "predicted")
    assert len(out) == len(docs)
    wrong = 0
    for i, held, score, predicted in out:
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)
        assert held == (i is None or zlib.crc32(str(i).encode()) % 5 == 0)
        wrong += i is not None and i < 900 and predicted != (i % 9 == 0)
    assert wrong == 0
    clean = toxicity.keep_clean(documents, model)
    assert clean.columns == documents.columns and clean.where("doc_id < 900").count() == 800


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no input tables here")
def test_toxicity_of_held_out_rows_of_the_tables(spark):
    scored = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic IS NOT NULL")
    pairs = rows_of(scored.join(labels, "doc_id"), "predicted", "toxic")
    hits, said, toxic = sum(p and t for p, t in pairs), sum(p for p, _ in pairs), sum(t for _, t in pairs)
    # some 300 labelled rows to learn from; 16,500 rows of the larger tables give 1.00 and 0.99
    assert len(pairs) > 50 and hits >= 0.9 * said and hits >= 0.6 * toxic


def test_terms_kept_grow_with_the_rows():
    rng, settings = random.Random(3), toxicity.Settings(bits=16, any_sample=4)
    for n in (400, 1600):
        rows = [(np.unique([rng.randrange(300 * (i % 2), 600) for _ in range(20)]).astype("<i4"), i % 2) for i in range(n)]
        assert 0 < len(toxicity.fit(rows, settings).index) <= n // settings.rows_per_term + n // settings.rows_per_pair


def test_toxicity_without_labels(spark):
    documents = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.train(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r[0] for r in rows_of(toxicity.score_texts(documents, model), "score")}) == 1
    assert toxicity.score_texts(documents.limit(0), model).count() == 0


# html


PAGES = {
    "<article><h1>T &amp; x</h1><p><b>one\n two<br><p>three</p></article><footer>f</footer>": "T & x\n\none two\n\nthree",
    "": "",
    "plain  text": "plain text",
    "<p>a &lt; b&nbsp;c</p>": "a < b c",
    "<script>if (a<b) x='</p>'</script><p>real text here</p>": "real text here",
    "<div class='ad'>buy</div><p>The story goes on and on.</p><form><p>mail</p></form>": "The story goes on and on.",
    "<nav><ul><li><a href=/>menu</a></ul></nav>": "",
    "<div id=comments><article class=comment>me too, I think so as well</article></div><article><p>Body of it.</article>": "Body of it.",
    "<article><p>cut off in the mid": "cut off in the mid",
    "<div style='overflow:hidden' data-hidden=x><p>shown</p></div><div style='display: none'>no</div><p hidden>no</p>": "shown",
    "<!-- <p>no</p> --><table><tr><td>x<td>y<tr><td>z</table>": "x\n\ny\n\nz",
    "<body><p>A&<b>lt;</b>B and so on</p></body>": "A&lt;B and so on",
    "<article><div class=cookie-notice>cookies</div><p>p1<aside>side</aside>tail</article>": "p1\n\ntail",
}


def test_html_cases(spark):
    rows = [(i, "u", h, "clash") for i, h in enumerate(PAGES)] + [(900, None, None, ""), (None, "u", "<p>x", ""), (901, "u", "<div>" * 20_000 + "deep", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r[0]: r[1:] for r in rows_of(html_extract.extract_text(pages), "page_id", "text", "n_chars")}
    for i, want in enumerate(PAGES.values()):
        assert got[i] == (want, len(want))
    assert got[900] == ("", 0) and got[None] == ("x", 1) and got[901] == ("deep", 4)
    assert html_extract.extract_text(pages.limit(0)).count() == 0


SENTENCE = "Sentences of an article that goes on for quite a while. "


def test_a_class_word_around_the_article_is_overruled():
    story = "".join(f"<p>{SENTENCE * 4}{i}</p>" for i in range(4))
    for name in ("related-work", "side", "legal", "search-results share", "notice"):
        got = html_extract.main_text(f'<body><nav><a href=x>menu</a></nav><div class="{name}">{story}</div><footer>foot</footer></body>')
        assert got.split("\n\n") == [f"{SENTENCE * 4}{i}" for i in range(4)]
    got = html_extract.main_text(f'<body><div><h1>T</h1>{story}</div><div class="related">{"<p>Another story to read.</p>" * 3}</div></body>')
    assert got.split("\n\n") == ["T", *(f"{SENTENCE * 4}{i}" for i in range(4))]


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["div", "section", "p", "span", "a", "b"]) if depth else rng.choice(["div", "section"])
        inner = "words " * rng.randrange(0, 30)
        if tag in ("div", "section") and depth < 4:
            inner += random_page(rng, depth + 1)
        name = rng.choice(["", "", "", ' class="promo"'])
        out.append(f"<{tag}{name}>{inner}</{tag}>")
    return "".join(out)


def brute_densities(root):
    """Definitions followed node by node: counts by walking each subtree anew."""

    def walk(node):
        yield node
        for c in node.nodes():
            yield from walk(c)

    def linked(node, above):
        return above or node.noise or node.tag == "a"

    def counts(node, above):
        chars = links = 0
        todo = [(node, above)]
        while todo:
            n, a = todo.pop()
            a = linked(n, a)
            own = sum(len(c.strip()) for c in n.children if isinstance(c, str))
            chars, links = chars + own, links + own * a
            todo += [(c, a) for c in n.nodes()]
        below = [n for c in node.nodes() for n in walk(c)]
        return chars, len(below), links, sum(n.tag == "a" or n.noise for n in below)

    body_chars, _, body_links, _ = counts(root, False)
    out = {}
    for node in walk(root):
        c, t, lc, lt = counts(node, False)
        if c:
            base = np.log(c * lc / max(c - lc, 1) + body_links * c / body_chars + np.e)
            out[id(node)] = c / max(t, 1) * np.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1 + 1e-9)) / np.log(base + 1)
        else:
            out[id(node)] = 0.0
    return out


@pytest.mark.parametrize("seed", range(30))
def test_densities_and_the_choice_of_the_subtree(seed):
    root = html_extract.parse(f"<body>{random_page(random.Random(seed))}</body>")
    order = html_extract.densities(root)
    want = brute_densities(root)
    for node in order:
        assert node.density == pytest.approx(want[id(node)], abs=1e-9)
        assert node.total == pytest.approx(sum(want[id(c)] for c in node.nodes()) or want[id(node)], abs=1e-9)
    article, above, threshold = html_extract.main_node(order)
    best = max(order, key=lambda n: n.total if n.chars > n.link_chars else 0.0)
    path, parents = [best], {id(c): n for n in order for c in n.nodes()}
    while id(path[-1]) in parents:
        path.append(parents[id(path[-1])])
    assert article in path and above == path[path.index(article) + 1 :]
    assert threshold == pytest.approx(min(want[id(n)] for n in path if n.chars), abs=1e-9)


def test_density_decides_and_not_size(monkeypatch):
    """A long list of short entries has more characters than the article, in many more tags."""
    listing = "<div>" + "".join(f"<div><span>entry</span> <span>number {i}</span></div>" for i in range(120)) + "</div>"
    page = f"<body><div>{''.join(f'<p>{SENTENCE * 3}</p>' for _ in range(4))}</div>{listing}</body>"
    assert html_extract.main_text(page).split("\n\n") == [(SENTENCE * 3).strip()] * 4
    monkeypatch.setattr(html_extract, "composite", lambda c, *_: float(c))
    assert "entry number 7" in html_extract.main_text(page)


@pytest.mark.parametrize(
    "page",
    ["<a '" * 260_000, "<div>" * 200_000, "<p>" + "<b>" * 90_000 + "<li></li>" * 90_000, "<" * 1_000_000, "<a x='" + '"' * 10**6, "<!--" * 250_000, "<div>" * 90_000 + "</p>" * 90_000],
)
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - start < 10


# warc


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 4)
    big, other = "<p>é</p>" * 300, "y" * 999
    rows = [(1, "http://a/\r\nx", big), (7, "http://b/", big), (3, None, big), (4, "u", other), (5, "u", other), (6, "u", None), (8, "u", "")]
    rows += [(None, "u", big), (9, "u", "z" * 3_000_000), (10, "u", "w" * 1000), (10, "u", "w" * 1000), ((1 << 60) + 1, "u", "v" * 2000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path)
    got = sorted(rows_of(read, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), key=str)
    largest = {}
    for i, _, h in rows:
        if i is not None and h and len(h.encode()) >= 1000:
            largest[h] = max(i, largest.get(h, i))
    want = []
    for i, _, h in rows:
        data, top = (h or "").encode(), largest.get(h)
        revisit = top is not None and i != top
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)
    kept = {r[0]: bytes(r[1]).decode() for r in rows_of(read.where("payload IS NOT NULL"), "page_id", "payload")}
    assert kept[7] == big and kept[9] == "z" * 3_000_000 and kept[6] == ""


def test_damaged_archives_are_found():
    good = warc.frame(1, "u", b"x" * 5000, None, hashlib.sha1(b"x" * 5000).hexdigest())
    assert warc.read_record(next(warc.members(warc.EMPTY_MEMBER + good)))["payload"] == b"x" * 5000
    with pytest.raises(warc.WarcError):
        list(warc.members(good[:-3]))
    data = next(warc.members(good))
    for broken in (data.replace(b"xxxx\r\n", b"xxxy\r\n"), data[:-1], data.replace(b"Content-Length: 5", b"Content-Length: 4")):
        with pytest.raises(warc.WarcError):
            warc.read_record(broken)


def test_no_pages_to_archive(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
