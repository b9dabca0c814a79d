"""The read-only guard, and batches that are replayed."""

import pytest

from loomkb.operators import sqltool
from loomkb.streaming import pipelines

SF = "/root/testdata/sf0.001"

ALLOWED = [
    "SELECT count(*) AS n FROM nation",
    "WITH r AS (SELECT * FROM region) SELECT n_name FROM nation JOIN r ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
    "SELECT (SELECT max(n_nationkey) FROM nation) AS m, sum(x) OVER () AS s FROM VALUES (1), (2) AS t(x)",
    "SELECT e.x FROM (SELECT explode(array(1, 2)) AS x) AS e WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = e.x)",
    "SELECT id FROM range(5) ORDER BY id LIMIT 2",
    "SELECT r_name FROM region UNION SELECT n_name FROM nation",
    "FROM nation |> WHERE n_nationkey > 3 |> AGGREGATE count(*) AS n GROUP BY n_regionkey |> SELECT n |> ORDER BY n |> LIMIT 2",
    "SELECT n_name, row_number() OVER w AS i, CASE WHEN n_name LIKE ANY ('A%', 'B%') THEN 1 ELSE 0 END AS c FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name DESC NULLS LAST)",
    "SELECT * FROM (SELECT n_regionkey, n_nationkey FROM nation) PIVOT (max(n_nationkey) FOR n_regionkey IN (0, 1))",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n FROM t",
    "SELECT r_name, e FROM region LATERAL VIEW explode(filter(array(1, 2, 3), x -> x > 1)) AS e",
    "SELECT n.n_name FROM nation AS n, LATERAL (SELECT r_name FROM region WHERE r_regionkey = n.n_regionkey) GROUP BY ROLLUP (n.n_name) HAVING count(*) > 0",
    "SELECT CAST(n_nationkey AS string) || 'x' AS s, n_nationkey::double / 3 AS d, named_struct('a', n_name).a AS b FROM NATION",
    "VALUES (1), (2)",
    "TABLE region",
]
REJECTED = [
    "DROP TABLE nation",
    "INSERT INTO nation SELECT * FROM nation",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT n_name FROM nation WHERE try_reflect('java.lang.System', 'getProperty', 'user.home') = n_name",
    "SELECT count(*) FROM text.`/etc/hostname`",
    "WITH t AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM t",
    "SELECT * FROM nation WHERE n_name IN (SELECT value FROM text.`/etc/hostname`)",
    "SELECT (SELECT max(java_method('java.lang.System', 'getProperty', 'user.home')) FROM region) AS x",
    "SELECT x FROM nation LATERAL VIEW explode(array(reflect('java.lang.System', 'getProperty', 'user.home'))) AS x",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT IDENTIFIER('n_name') FROM nation",
    "FROM nation |> SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "FROM text.`/etc/hostname` |> SELECT value",
    "FROM nation |> JOIN text.`/etc/hostname` ON true",
    "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT transform(array(1), x -> java_method('java.lang.System', 'getProperty', 'user.home')) FROM nation",
    "SELECT n_name FROM nation ORDER BY reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT sum(1) OVER (ORDER BY reflect('java.lang.System', 'getProperty', 'user.home')) FROM nation",
    "SELECT TRANSFORM(n_name) USING 'cat' FROM nation",
    "SELECT * FROM nation VERSION AS OF 3",
    "SELECT * FROM STREAM nation",
    "SELECT * FROM range(3) r JOIN LATERAL java_method('a', 'b') e",
    "SELECT * FROM VALUES (java_method('java.lang.System', 'getProperty', 'user.home')) AS t(x)",
    "SELECT * FROM nation PIVOT (max(reflect('a', 'b')) FOR n_regionkey IN (0, 1))",
    "SET spark.sql.ansi.enabled = false",
    "EXPLAIN SELECT 1",
    "SELECT ((",
    "CACHE TABLE nation",
    "DESCRIBE nation",
    "SELECT 1; DROP TABLE nation",
    "BEGIN SELECT 1; END",
    "SELECT no_such_function(1)",
    "SELECT * FROM somewhere_else",
    "",
]


@pytest.mark.parametrize("query", ALLOWED)
def test_queries_run(spark, query):
    assert sqltool.run_query(spark, SF, query).count() > 0


@pytest.mark.parametrize("query", REJECTED)
def test_everything_else_is_rejected(spark, query):
    with pytest.raises(sqltool.ReadOnlyError):
        sqltool.check_read_only(spark, query)


def test_a_view_reads_what_it_was_made_of_and_no_more(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "ids"))
    spark.read.parquet(str(tmp_path / "ids")).createOrReplaceTempView("own_ids")
    assert sqltool.run_query(spark, SF, "SELECT o.id, r_name FROM own_ids o JOIN region ON id = r_regionkey").count() == 3
    assert sqltool.run_query(spark, SF, "WITH own_ids AS (SELECT 7 AS id) SELECT id FROM own_ids").first() == (7,)
    spark.catalog.dropTempView("own_ids")


def test_replayed_batch_writes_its_rows_again(spark, tmp_path):
    path = str(tmp_path / "out")
    handle = pipelines.append_unknown(path, ["k"])
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    second = spark.createDataFrame([(2, "x"), (3, "c")], "k long, v string")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect())
    for batch, batch_id, want in ((first, 0, 2), (first, 0, 2), (second, 1, 3), (second, 1, 3), (first, 0, 3)):
        handle(batch, batch_id)
        assert len(read()) == want
    assert read() == [(1, "a"), (2, "b"), (3, "c")]
