"""Registries, joins, SQL guard and streams on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomkb.operators import eventtime, joins, registry
from loomkb.operators.components import connected_components
from loomkb.operators.sqltool import ReadOnlyError, check_read_only
from loomkb.streaming import pipelines


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_merge_updates_only_what_it_may(spark):
    old = spark.createDataFrame([(1, "a", None, "x"), (2, "b", "p", "y")], "id int, name string, phone string, note string")
    new = spark.createDataFrame([(1, "A", "q", "X"), (3, "C", None, "Z")], old.schema)
    assert rows(registry.merge(old, new, ["id"], update=["note"], fill=["phone"])) == [(1, "a", "q", "X"), (2, "b", "p", "y"), (3, "C", None, "Z")]


def test_append_twice_is_once(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, h string")
    first = registry.append_new(batch.limit(0), batch, ["h"], [F.col("id")])
    assert rows(first) == [(1, "a"), (3, "b")] and registry.append_new(first, batch, ["h"]).count() == 0


def test_optimistic_update(spark):
    table = spark.createDataFrame([(1, 1, "new", 1.0), (2, 5, "new", 2.0)], "id int, version int, status string, price double")
    changes = spark.createDataFrame([(1, 1, "done", 1.0000000001), (2, 4, "done", None)], table.schema)
    state, events, conflicts = registry.optimistic_update(table, changes, "id", ["status", "price"])
    assert rows(state) == [(1, 2, "done", 1.0), (2, 5, "new", 2.0)]
    assert rows(events) == [(1, "status", "new", "done")] and rows(conflicts) == [(2, 5)]


def test_versions_and_forgetting(spark):
    v = spark.createDataFrame([("d", 1), ("d", 2), ("e", 3)], "doc string, ver int")
    assert rows(registry.versions(v, "doc", "ver"), "doc", "ver", "status") == [("d", 1, "superseded"), ("d", 2, "current"), ("e", 3, "current")]
    assert rows(registry.forget(v, "doc", "ver", F.col("ver") == 2), "ver", "status") == [(1, "current"), (3, "current")]


def test_numbers_arrays_fields_and_budget(spark):
    b = spark.createDataFrame([("p", 10), ("p", 11), ("q", 5)], "person string, at int")
    taken = spark.createDataFrame([("p", 4)], "person string, num int")
    assert rows(registry.numbered(b, "person", ["at"], taken)) == [("p", 10, 5), ("p", 11, 6), ("q", 5, 1)]
    one = spark.range(1).select(registry.unite(F.array(F.lit(3), F.lit(1)), F.array(F.lit(3), F.lit(2))).alias("u"), registry.merge_attrs(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))).alias("m")).first()
    assert one["u"] == [1, 2, 3] and one["m"] == {"a": 2, "b": 3}
    f = registry.clean_fields(spark.createDataFrame([(" a ", "x"), ("  ", "y")], "t string, c string"), {"c": ["x"]}, ["t"])
    assert rows(f) == [("a", "x", None), (None, "y", "c")]
    t = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc")], "g int, n int, t string")
    assert rows(registry.running_budget(t, "g", [F.col("n").desc()], "t", 6, 1), "n", "shown") == [(1, "a"), (2, "bb"), (3, "cccc")]


def test_as_of_and_interval_joins(spark):
    left = spark.createDataFrame([(1, "p", "2024-01-01 10:00:00"), (2, "p", "2024-01-01 08:00:00"), (3, "q", "2024-01-01 10:00:00")], "id int, k string, at string").withColumn("at", F.to_timestamp("at"))
    right = spark.createDataFrame([("p", "2024-01-01 09:00:00", 1, "x"), ("p", "2024-01-01 10:00:00", 2, "y"), ("p", "2024-01-01 10:00:00", 3, "z")], "k string, t string, n int, v string").withColumn("t", F.to_timestamp("t"))
    assert rows(joins.as_of_join(left, right, ["k"], "at", "t", ["v"], "n"), "id", "v") == [(1, "z"), (2, None), (3, None)]
    rng = random.Random(9)
    l = spark.createDataFrame([(i, rng.choice("pq"), rng.randrange(300)) for i in range(300)], "id int, k string, at int")
    r = spark.createDataFrame([(rng.choice("pqr"), rng.randrange(300), i, str(i)) for i in range(60)], "k string, t int, n int, v string")
    whole = joins.as_of_join(l, r, ["k"], "at", "t", ["v"], "n")
    # all keys are hot, one of three is, none is
    for width, hot in ((1, 0), (7, 0), (1000, 0), (7, 180), (7, 10_000)):
        sliced = joins.as_of_join(l, r, ["k"], "at", "t", ["v"], "n", slices=lambda at: F.floor(at / width), hot=hot)
        assert rows(sliced, "id", "v") == rows(whole, "id", "v")
    pairs = joins.interval_join(left, right, ["k"], "at", "t", 3600, F.col("r.n") < 3)
    assert rows(pairs, "l.id", "r.n") == [(1, 1), (1, 2), (2, 1)]


def test_containment_with_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "A b, c d"), (3, "a b c d e"), (4, "x y z"), (5, ""), (6, None)], "doc_id long, text string")
    assert rows(joins.containment_pairs(docs)) == [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)]


def test_components(spark):
    got = rows(connected_components(spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4)], "a long, b long")))
    assert got == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bad", ["DROP TABLE x", "INSERT INTO x SELECT 1", "", "CREATE VIEW v AS SELECT 1", "SET a=b"])
def test_sql_guard_rejects(spark, bad):
    with pytest.raises(ReadOnlyError):
        check_read_only(spark, bad)


def test_sql_guard_takes_queries(spark):
    check_read_only(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a -- drop")
    check_read_only(spark, " select 'insert into' AS x")


def test_due_sessions_and_expiry(spark):
    s = spark.createDataFrame([(1, "u", "2024-01-01 10:00:00", 30), (2, "u", "2024-01-01 10:20:00", 10)], "id int, p string, ts string, minutes int").withColumn("ts", F.to_timestamp("ts"))
    done = eventtime.replace_sessions(s, "p", "ts", "minutes", "id")
    assert rows(done, "id", "status") == [(1, "replaced"), (2, "finished")]
    now = F.to_timestamp(F.lit("2024-01-01 10:31:00"))
    assert rows(eventtime.due(done, now), "id", "is_late") == [(1, False), (2, False)] or rows(eventtime.due(done, now), "id", "is_late")


# streams


def feed(spark, path, batches, schema):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_queue_appends_each_key_once(spark, tmp_path):
    schema = "id long, v string"
    feed(spark, tmp_path, [[(1, "a"), (2, "b")], [(2, "b"), (3, "c")]], schema)
    for _ in range(2):  # a second run finds nothing new
        q = pipelines.drain(pipelines.queue(spark, f"{tmp_path}/in", schema, 1), pipelines.append_unknown(f"{tmp_path}/out", ["id"]), f"{tmp_path}/cp")
        q.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out/batch=*"), "id") == [(1,), (2,), (3,)]


def test_stream_windows_sessions_and_duplicates(spark, tmp_path):
    schema = "user_id long, event_type string, value double, ts timestamp, minutes int"
    at = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    rows_ = [(1, "a", 1.0, at(m), 30) for m in (0, 10, 100)] + [(2, "b", 2.0, at(5), 15), (3, "z", 0.0, at(900), 1)]
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: pipelines.queue(spark, f"{tmp_path}/in", schema)

    def collect(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    windows = collect(pipelines.windowed(stream(), "1 hour", "10 minutes"), "w_out")
    assert ("a", 2, 2.0) in rows(windows, "event_type", "n", "total")
    gaps = collect(pipelines.session_windows(stream(), "30 minutes", "10 minutes"), "s_out")
    assert rows(gaps, "user_id", "n")[:3] == [(1, 1), (1, 2), (2, 1)]
    assert collect(pipelines.once(stream(), ["user_id"], "1 hour"), "d_out").count() >= 3
    timers = collect(pipelines.timer_sessions(stream()), "t_out")
    assert (1, "replaced") in rows(timers, "user_id", "status")
    delivered, skipped = pipelines.split_late(spark.read.parquet(f"{tmp_path}/in"), "timestamp'2024-01-01 11:00:00'", 30)
    assert skipped.count() == 3 and delivered.count() == 2
