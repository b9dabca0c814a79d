"""The pipeline against a brute-force version of each stage."""

import random
import re

import corpus_pipeline
from loomkb.llm import exact_dedup, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())


def made_up(rng):
    docs, labels = [], []
    for i in range(260):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 40, 150]))]
        toxic = i % 6 == 0
        if toxic:
            words[3:3] = ["idiot", "scum", "moron"]
        docs.append((i, " ".join(words), "en", f"s{i % 3}" if i % 11 else None, 0))
        labels.append((i, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 6]
    for k, (i, t, *_) in enumerate(rng.sample(clean, 40)):
        docs.append((1000 + k, t.upper() if k % 2 else t, "en", "s1", 0))
    for k, (i, t, *_) in enumerate(rng.sample([d for d in clean if len(d[1].split()) == 150], 20)):
        words = t.split()
        words[rng.randrange(150)] = f"edit{k}"
        docs.append((2000 + k, " ".join(words), "en", "s2", 0))
    return docs + [(3000, None, None, None, None), (3001, "", "en", "s0", 0)], labels


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
    return ({tuple(w)} if w else set()) if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_stages(spark, tmp_path):
    docs, labels = made_up(random.Random(20))
    sf = str(tmp_path)
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    state = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = state.columns, {d[0]: d for d in docs}
    model = toxicity.train(state, spark.read.parquet(f"{sf}/labels.parquet"))
    terms = toxicity.Terms(model.bits)
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, state, sf).write.parquet(f"{sf}/{k}")
        state = spark.read.parquet(f"{sf}/{k}")
        if k < 4:
            assert state.columns == columns
            after.append([tuple(r) for r in state.collect()])
    # toxicity: what the model rejects goes, and that is the toxic documents
    kept = {i: d for i, d in kept.items() if model.score(terms(d[1])) < 0.5}
    assert sorted(d[0] for d in after[0]) == sorted(kept) and not any(i < 260 and i % 6 == 0 for i in kept) and len(kept) > 250
    # exact dedup: the largest id of equal texts
    best = {}
    for i, d in kept.items():
        best[(d[1] or "").translate(UPPER)] = max(i, best.get((d[1] or "").translate(UPPER), i))
    kept = {i: kept[i] for i in best.values()}
    assert sorted(d[0] for d in after[1]) == sorted(kept)
    # near duplicates: the smallest id of what hangs together
    sets, root = {i: shingles(d[1]) for i, d in kept.items()}, {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in kept:
        for b in kept:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i: kept[i] for i in kept if find(i) == i}
    assert sorted(d[0] for d in after[2]) == sorted(kept) and len(kept) < len(sets) - 10
    # mixing: whole copies, at most three
    copies = {}
    for d in after[3]:
        copies[d[0]] = copies.get(d[0], 0) + 1
        assert d == kept[d[0]]
    assert max(copies.values()) <= 3
    # packing: every copy's ids, once each
    pieces = state.collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: n * next(p.doc_tokens for p in pieces if p.doc_id == i) for i, n in copies.items()}
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, rows that share an id, very long texts and columns with the names that operators use."""
    sf = str(tmp_path)
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, words(40), "en", f"s{i % 2}", 0, "x", 1.0) for i in range(60)]
    rows += [rows[0]] * 3 + [(0, words(30), "en", "s0", 0, "y", None), (None, words(20), None, None, None, None, None), (None, None, "en", "s1", 0, "z", 2.0)]
    rows += [(90, None, "en", "s1", 0, "z", 2.0), (91, "", "en", "s1", 0, "z", 2.0), (92, words(60_000), "en", "s0", 1, "long", 3.0)]
    schema = COLUMNS + ", label string, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    state = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = state.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, state, sf).write.parquet(f"{sf}/{k}")
        state = spark.read.parquet(f"{sf}/{k}")
        counts.append(state.count())
        assert k == 4 or state.columns == columns
    # without labels nothing is toxic; the repeated row stays once, of the texts that are null or empty one stays
    assert counts[0] == len(rows) and counts[1] == len(rows) - 3 - 2 and counts[2] == counts[1]
    kept = spark.read.parquet(f"{sf}/1").collect()
    assert sorted(r.doc_id for r in kept if not r.text) == [91]
    assert sum(r.doc_id == 0 for r in kept) == 2 and sum(r.doc_id is None for r in kept) == 1
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/3").select("doc_id").collect()}
    assert {r.doc_id for r in state.select("doc_id").collect()} == ids


def test_pipeline_of_nothing(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_mixing_stage_takes_what_the_targets_ask_for(spark, tmp_path):
    """Words of each source against shares worked out one by one."""
    rng = random.Random(22)
    rows = [(i, "w " * rng.randrange(1, 300), "en", rng.choice("abbbbc"), 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, COLUMNS)
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "abc"}
    want, free, left = {}, dict(zip("abc", (1, 2, 3))), sum(sizes.values())
    while True:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * sizes[s]
            left -= want[s]
            del free[s]
    want |= share
    got = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    for s in "abc":
        taken = sum(len(r.text.split()) for r in got if r.source == s)
        assert abs(taken - want[s]) <= max(0.01 * want[s], 3)
