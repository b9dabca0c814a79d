"""Threads batch by batch against all at once."""

import random

import pytest

from loomkb.operators import incremental
from loomkb.operators.ledger import Ledger

LETTERS = "chain long, letter string"


def all_at_once(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for chain, letter in rows:
        if chain is not None:
            find(("c", chain))
            if letter is not None:
                parent[find(("l", letter))] = find(("c", chain))
    smallest = {}
    for kind, value in list(parent):
        if kind == "c":
            root = find((kind, value))
            smallest[root] = min(value, smallest.get(root, value))
    return {v: smallest[find(("l", v))] for k, v in parent if k == "l"}, {v: smallest[find(("c", v))] for k, v in parent if k == "c"}


def state(ledger):
    letters, chains = incremental.threads(ledger.snapshot())
    return {r["letter"]: r["thread"] for r in letters.collect()}, {r["chain"]: r["thread"] for r in chains.collect()}


def given(rng):
    rows = [(rng.randrange(60), f"m{rng.randrange(90)}") for _ in range(110)]
    return rows + [(7, None), (None, "m1"), (200, None), (3, "m1"), (3, "m1")]


@pytest.mark.parametrize("seed", range(1))
def test_ten_batches_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = given(rng)
    want = all_at_once(rows)
    rng.shuffle(rows)
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    batches = [rows[i::10] for i in range(10)]
    for i, batch in enumerate(batches):
        incremental.ingest(ledger, "mail", i, spark.createDataFrame(batch, LETTERS))
    assert state(ledger) == want
    version = ledger.version()
    for i in (9, 3):
        incremental.ingest(ledger, "mail", i, spark.createDataFrame([(1, "m1"), (59, "m1")], LETTERS))
    assert ledger.version() == version and state(ledger) == want


def test_a_stream_of_letters(spark, tmp_path):
    rows = given(random.Random(9))
    source, ledger = str(tmp_path / "in"), Ledger(spark, f"file://{tmp_path}/l")
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, LETTERS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LETTERS).parquet(source).writeStream.option("checkpointLocation", str(tmp_path / "c"))
        stream.foreachBatch(incremental.batch_writer(ledger, "stream")).trigger(availableNow=True).start().awaitTermination()
    assert state(ledger) == all_at_once(rows)


def test_a_merge_of_old_threads_is_one_row_each(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    for i, rows in enumerate([[(10, "a")], [(20, "b")], [(30, "c")], [(40, "a"), (40, "b"), (40, "c")], [(5, "c")], []]):
        incremental.ingest(ledger, "m", i, spark.createDataFrame(rows, LETTERS))
    at = ledger.snapshot()
    assert sorted((r["thread"], r["merged_into"]) for r in at.table("merges").collect()) == [(10, 5), (20, 10), (30, 10)]
    assert state(ledger) == ({"a": 5, "b": 5, "c": 5}, {10: 5, 20: 5, 30: 5, 40: 5, 5: 5})
