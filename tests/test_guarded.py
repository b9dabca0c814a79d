"""Turns of requests, rates over partitions, and the breaker."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomkb.operators import guarded


def watch():
    """Makes clocks that move by waiting, and a tenth of a second with each look."""

    class Watch:
        def __init__(self):
            self.at = 0.0

        def now(self):
            self.at += 0.1
            return self.at

        def wait(self, seconds):
            self.at += seconds

    return Watch


def test_turns(spark):
    start = dt.datetime(2024, 5, 1)
    given = [("a", i, start + dt.timedelta(seconds=s)) for i, s in enumerate((0, 0, 0.1, 5, 5.2, 20))] + [("b", 9, start), ("a", 10, None)]
    got = guarded.paced(spark.createDataFrame(given, "service string, id long, at timestamp"), 2)
    turns = {(r["service"], r["id"]): r["turn"] and (r["turn"] - start).total_seconds() for r in got.collect()}
    assert turns == {("a", 0): 0, ("a", 1): 0.5, ("a", 2): 1, ("a", 3): 5, ("a", 4): 5.5, ("a", 5): 20, ("b", 9): 0, ("a", 10): None}


def test_rate_is_held_over_partitions(spark):
    requests = spark.range(60).select((F.col("id") % 3).cast("string").alias("service"), "id", F.lit("x").alias("payload")).repartition(6)
    got = guarded.guarded_calls(requests, lambda service, payload: service + payload, 0.5, clock=watch())
    by_service = {}
    for r in got.orderBy("service", "id").collect():
        assert r["answer"] == r["service"] + "x" and r["error"] is None
        by_service.setdefault(r["service"], []).append(r["sent"])
    assert len(by_service) == 3
    for sent in by_service.values():
        assert sent == sorted(sent) and all(b - a >= 2 - 1e-9 for a, b in zip(sent, sent[1:]))


def test_the_breaker_opens_and_half_opens(spark):
    def call(service, payload):
        if payload == "bad":
            raise ValueError("down")
        return "ok"

    def run(*payloads):
        requests = spark.createDataFrame([("s", i, p) for i, p in enumerate(payloads)] + [(None, 99, "good")], "service string, id long, payload string")
        rows = guarded.guarded_calls(requests, call, 10, cool_down=0.55, clock=watch()).orderBy("id").collect()
        assert rows[-1]["error"] == "no service"
        return [r["error"] or r["answer"] for r in rows[:-1]]

    # two failures and a success leave it closed
    assert run("bad", "bad", "good", "bad", "bad", "good") == ["down", "down", "ok", "down", "down", "ok"]
    # three open it; a trial after the cooling time closes it, or opens it again
    got = run(*["bad"] * 3, *["good"] * 12)
    assert got[:4] == ["down"] * 3 + ["open"] and "ok" in got and got[got.index("ok") :] == ["ok"] * (len(got) - got.index("ok"))
    got = run(*["bad"] * 20)
    assert got[:4] == ["down"] * 3 + ["open"] and got.count("down") > 3 and got.count("open") > 8
    trials = [i for i, g in enumerate(got) if g == "down"][3:]
    assert all(got[i + 1] == "open" for i in trials if i + 1 < len(got))


@pytest.mark.parametrize("rows", [[], [(None, 1, None)]])
def test_nothing_to_send(spark, rows):
    requests = spark.createDataFrame(rows, "service string, id long, payload string")
    assert guarded.guarded_calls(requests, lambda s, p: "x", 1, clock=watch()).where("sent IS NOT NULL").count() == 0
