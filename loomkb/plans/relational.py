"""The relational surface: one text per query, run by the read-only SQL tool and by the oracle alike."""

from __future__ import annotations

from functools import partial

from loomkb.operators.sqltool import run_query

#: Valid in both dialects. Sums of integers are cast, sums of doubles rounded.
SHARED = {
    # scans, projections, filters
    "scan_filter_project": """
        SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS net
        FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.02 AND 0.06""",
    "null_safe_inequality": "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'",
    "optional_parameter": "SELECT doc_id FROM documents WHERE (CAST(NULL AS STRING) IS NULL OR lang = 'xx') AND n_chars > 5000",
    "ilike_search": """
        SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%a%' AND concat_ws(' ', p_brand, p_type) ILIKE '%bra%'""",
    "case_rules": """
        SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS size_class FROM documents""",
    "open_status_filter": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')",
    # joins
    "join_inner": """
        SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        WHERE c.c_mktsegment = 'BUILDING'""",
    "join_left": """
        SELECT c.c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS n_orders FROM customer c
        LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""",
    "join_right": """
        SELECT n.n_name, CAST(count(s.s_suppkey) AS BIGINT) AS n_suppliers FROM supplier s
        RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""",
    "join_full": """
        SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers
        FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c
        FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c.c_nationkey = s.s_nationkey""",
    "join_semi": """
        SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)""",
    "join_anti": """
        SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""",
    "uncovered_requirements": """
        SELECT p.p_partkey FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') l
        ON l.l_partkey = p.p_partkey WHERE l.l_partkey IS NULL""",
    "join_in_subquery": """
        SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""",
    "join_cross_one_row": """
        SELECT o.o_orderkey, round(o.o_totalprice / a.mean, 6) AS ratio
        FROM orders o CROSS JOIN (SELECT avg(o_totalprice) AS mean FROM orders) a""",
    "join_theta_interval": """
        SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id
        AND a.event_id < b.event_id AND b.ts BETWEEN a.ts - INTERVAL 14 HOURS AND a.ts + INTERVAL 14 HOURS""",
    "join_nested_loop": """
        SELECT r.r_name, CAST(count(*) AS BIGINT) AS n FROM region r JOIN nation n ON n.n_regionkey <> r.r_regionkey GROUP BY r.r_name""",
    "scalar_subquery": """
        SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c""",
    "correlated_min_max": """
        SELECT c_custkey, (SELECT min(o_orderdate) FROM orders o WHERE o.o_custkey = c.c_custkey) AS first_at,
               (SELECT max(o_orderdate) FROM orders o WHERE o.o_custkey = c.c_custkey) AS last_at FROM customer c""",
    # aggregation
    "agg_filter": """
        SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS n_large,
               round(sum(l_extendedprice) FILTER (WHERE l_discount = 0), 2) AS undiscounted FROM lineitem GROUP BY l_returnflag""",
    "agg_pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "agg_distinct": """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""",
    "agg_grouping_sets": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
        GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
    "agg_cube": """
        SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "agg_rollup": """
        SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)""",
    "agg_having": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 10",
    "index_stats": """
        SELECT count(*) AS total, count(e.vec_id) AS embedded, count(*) FILTER (WHERE coalesce(l.toxic, 0) = 0) AS active
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "health_counts": """
        SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages,
               (SELECT count(*) FROM conversations) AS letters, (SELECT count(DISTINCT conv_id) FROM conversations) AS threads""",
    "distinct_persons": "SELECT DISTINCT user_id FROM events",
    "next_number_per_person": """
        SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS num FROM events""",
    # windows
    "window_row_number_topk": """
        SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn
                       FROM orders) t WHERE rn <= 3""",
    "window_rank_family": """
        SELECT s_suppkey, CAST(rank() OVER w AS BIGINT) AS rnk, CAST(dense_rank() OVER w AS BIGINT) AS drnk, CAST(ntile(4) OVER w AS BIGINT) AS quartile,
               round(percent_rank() OVER w, 9) AS pct FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""",
    "window_lead_lag": """
        SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_turn,
               turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations""",
    "window_frames_rows": """
        SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving
        FROM events""",
    "window_frames_range": """
        SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS recent
        FROM orders""",
    "window_running_budget": """
        SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2000 AS inside FROM conversations""",
    "window_islands": """
        SELECT user_id, grp, min(event_id) AS first_id, count(*) AS n, min(event_type) AS event_type FROM (
          SELECT user_id, event_id, event_type, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp FROM (
            SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh
            FROM events) a) b GROUP BY user_id, grp""",
    # sorts, limits, set operations
    "sort_nulls_last": """
        SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) t
        ORDER BY quality DESC NULLS LAST, doc_id LIMIT 50""",
    "topk_tiebreak": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "capped_limit": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100",
    "set_union_all": "SELECT lang AS v, 'lang' AS src FROM documents UNION ALL SELECT role AS v, 'role' AS src FROM conversations",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "set_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.08",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N'",
    "set_except_all": "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey AS k FROM nation",
    "recursive_hops": """
        WITH RECURSIVE hops AS (
          SELECT n_nationkey AS node, n_regionkey AS src, 1 AS depth FROM nation WHERE n_regionkey = 1
          UNION ALL SELECT n.n_nationkey, h.node, h.depth + 1 FROM hops h JOIN nation n ON n.n_regionkey = h.node WHERE h.depth < 3)
        SELECT node, src, CAST(depth AS BIGINT) AS depth FROM hops""",
    # stars
    "q3_shipping_priority": """
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer
        JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "q5_local_supplier": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer
        JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    # registries over the star tables
    "issue_list": """
        SELECT o.o_orderkey AS id, o.o_orderstatus AS status, o.o_orderpriority AS priority, c.c_name AS initiator, coalesce(l.n, 0) AS attachments
        FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
        WHERE o.o_orderstatus = 'O' AND o.o_orderpriority = '1-URGENT' ORDER BY o.o_orderdate DESC NULLS LAST, id LIMIT 200""",
    "contact_search": """
        SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%7%' OR c_mktsegment ILIKE '%7%' ORDER BY c_acctbal DESC, c_custkey LIMIT 50""",
    "contour_subtree": """
        SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey
        AND (n.n_regionkey = 2 OR n.n_nationkey = 2))""",
    "graph_one_hop": """
        SELECT n.n_name AS src, 'in_region' AS rel, r.r_name AS dst FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
        WHERE r.r_name ILIKE '%a' ORDER BY src LIMIT 100""",
    "thread_rollup": """
        SELECT conv_id, count(*) AS letters, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT role) AS roles,
               CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""",
    "thread_latest": """
        SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t WHERE rn = 1""",
    "empty_threads": """
        SELECT DISTINCT conv_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'assistant')""",
    "attachments_seen_elsewhere": """
        SELECT DISTINCT a.doc_id, b.doc_id AS other FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id""",
}

#: The two dialects place IGNORE NULLS differently.
FORWARD_FILL = """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END {0}) {1} OVER
           (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events"""

QUERIES = {name: partial(run_query, query=sql) for name, sql in SHARED.items()}
QUERIES["window_forward_fill"] = partial(run_query, query=FORWARD_FILL.format("", "IGNORE NULLS"))
ORACLES = SHARED | {"window_forward_fill": FORWARD_FILL.format("IGNORE NULLS", "")}
