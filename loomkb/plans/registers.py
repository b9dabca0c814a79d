"""Text identities, the assistant's registers and intake on whole input tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomkb.functions import scoring, text
from loomkb.operators import intake, issues, library, secretary
from loomkb.session import table

NOW = "2024-01-20 12:00:00"


def _host(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)


def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


def public_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", library.public_host(_host(F.col("url")), ("example.net",)).alias("public"))


def control_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.text_safe(F.col("text")), 256).alias("sha"))


def titled_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_fingerprint(F.col("text"), F.col("source")).alias("fingerprint"))


def sender_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    address = F.concat(F.lower("c_mktsegment"), F.lit("@example.com"))
    return c.select("c_custkey", text.sender_key(F.when(F.col("c_acctbal") > 0, F.col("c_name")), address).alias("who"))


def letter_keys(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    at = F.to_timestamp(F.concat(F.lit("2024-01-01 10:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":30")))
    keys = text.dedup_keys(F.col("role"), F.lit(None).cast("string"), at, F.col("text"))
    return c.select("conv_id", "turn", F.array_join(keys, "\n").alias("keys"))


def lines_added(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    before = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return before.where("before IS NOT NULL").select("conv_id", "turn", F.array_join(text.added_lines(F.col("text"), F.col("before")), "\n").alias("added"))


def first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.first_sentence(F.col("text")).alias("first"))


def issue_number_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    number = text.issue_number(F.col("o_orderkey"))
    return o.select("o_orderkey", number.alias("number"), text.parse_number(number).alias("parsed"))


def worst_results(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    steps = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat("l_returnflag", "l_linestatus"))).alias("r"))
    return steps.select("l_orderkey", scoring.worst_result(F.col("r")).alias("worst"))


def _sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select("event_id", F.col("user_id").alias("person"), F.lit("running").alias("status"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), (F.col("ts") + F.expr("INTERVAL 50 MINUTES")).alias("ends_at"))


def stopped_sessions(spark, sf_dir):
    stops = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("person"), F.col("ts").alias("at"))
    return secretary.stop_sessions(_sessions(spark, sf_dir), stops).select("event_id", "status", F.unix_micros("finished_at").alias("finished_at"))


def session_times(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    times = _sessions(spark, sf_dir).withColumn("person", F.col("event_id"))
    return secretary.session_status(times, now).select("person", "minutes_left", "minutes_passed")


def page_marks(spark, sf_dir):
    """Suppliers' parts as marks in books, parts as books of so many pages."""
    log = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("book"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("page"))
    log = log.groupBy("book", "at", "id").agg(F.max("page").alias("page"))
    books = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("total_pages"))
    return secretary.page_marks(log, books).select("book", "id", "at", "page", "delta", "percent")


def sections_at(spark, sf_dir):
    """Orders placed among the customers of their customer's nation, by number."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    marks = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("book"), (F.col("o_orderkey") % 100000).alias("page"))
    toc = c.select(F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("page"), F.col("c_name").alias("title"), F.col("c_custkey").alias("entry"))
    return secretary.section_at(marks, toc).select("o_orderkey", "section")


def answers_checked(spark, sf_dir):
    """Items' first words as facts that the document of the same number must hold."""
    facts = F.filter(F.slice(F.split("text", " "), 1, 4), lambda w: F.length(w) > 1)
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), facts.alias("answer_must_contain"))
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    return library.check_answers(cases, answers).select("id", "answer_ok", F.array_join("missing", "|").alias("missing"))


def title_neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lower("p_type").alias("kind"))
    return library.similar_titles(p, "cold widget", "economy")


def cached_answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("at"))
    had = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("answered_at"), F.col("event_id").alias("answer"))
    had = had.groupBy("user_id", "answered_at").agg(F.max("answer").alias("answer"))
    fresh, again = intake.cached(asked, had, ["user_id"], 3600)
    return fresh.select("event_id", "answer").unionByName(again.select("event_id", F.lit(None).cast("long").alias("answer")))


def query_words(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query"), F.explode(text.words(F.col("text"))).alias("word"))
    return intake.any_word_query(c).select("query", "words")


def attachment_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    files = c.select(F.col("conv_id").alias("message"), F.col("turn").alias("position"), F.sha2("text", 256).alias("sha256"), F.repeat("text", 20).alias("text"))
    return intake.attachment_texts(files).select("message", "position", F.length("shown").cast("long").alias("n"))


def articles_published(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.where("lang = 'de'").select(F.sha2("text", 256).alias("sha256"))
    articles = d.select(F.concat_ws(" ", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("title"), "text")
    return issues.publish(known, articles).select("name", "sha256", "size", "status")


def quotes_dedented(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.dedent_quoted(F.col("text")), 256).alias("sha"))


def links_tidied(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.tidy_links(F.col("html")), 256).alias("sha"))


def filenames_cleaned(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clean_filename(F.concat_ws("-", F.left(F.sha1("text"), F.lit(8)), "source", "lang")).alias("name"))


def object_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.object_key(F.concat(F.lit("Справочник."), "p_name", F.lit(" и "), "p_type")).alias("key"))


def file_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("doc_id").alias("position"), F.concat_ws(".", "source", "lang").alias("filename"), F.col("lang").alias("kind"), F.when(F.length("text") > 500, "long").otherwise("").alias("about"), F.lit("new").alias("relation"), F.lit("add").alias("action"))
    return intake.file_block(items).select("position", "line")


def settings_put(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("person"), (F.col("c_nationkey") > 10).alias("astro"), F.lit(False).alias("planets"), F.lit(None).cast("boolean").alias("stars"))
    asked = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.bool_or(F.col("o_totalprice") > 200000).alias("astro"), F.lit(None).cast("boolean").alias("planets"), F.bool_and(F.col("o_orderstatus") == "F").alias("stars"))
    return secretary.put_settings(old, asked)


QUERIES = {
    f.__name__: f
    for f in (
        safe_filenames, public_hosts, control_chars, titled_fingerprints, sender_keys, letter_keys, lines_added, first_sentences, issue_number_forms,
        worst_results, stopped_sessions, session_times, page_marks, sections_at, answers_checked, title_neighbours, cached_answers, query_words, attachment_budget,
        articles_published, quotes_dedented, links_tidied, filenames_cleaned, object_keys, file_lines, settings_put,
    )
}

_BARE = r"regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
_WORDS = r"regexp_extract_all(translate(lower({t}), 'ё', 'е'), '[\p{{L}}\p{{N}}_]+')"
_SAFE = r"""(SELECT CASE WHEN b = '' THEN 'file' ELSE left(b, 150) END FROM (SELECT regexp_replace(regexp_replace({t}, '[<>:"|?*\x00-\x1f]+', '_', 'g'), '^[\s.]+|[\s.]+$', '', 'g') AS b))"""
_STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOP)
_STEMS = rf"""list_distinct(list_transform(list_filter(regexp_extract_all(translate(translate(lower({{t}}), 'ё', 'е'), '_', ' '), '[a-zа-яё]+'),
    lambda w: NOT list_contains([{_STOP}], w) AND length(w) > 1), lambda w: left(w, 6)))"""
_NORM = r"""trim(regexp_replace(regexp_replace(translate(lower({t}), 'ё', 'е'), '[«»"''„“”]', '', 'g'), '\s+', ' ', 'g'), ' ')"""
_SIGNUPS = "s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup')"

ORACLES = {
    "safe_filenames": f"""SELECT page_id, CASE WHEN url IS NOT NULL THEN {_SAFE.format(t="regexp_extract(replace(url, chr(92), '/'), '[^/]*$')")} END AS name FROM pages""",
    "public_hosts": r"""
        WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)), '\.$', '') AS h FROM pages)
        SELECT page_id, contains(h, '.') AND NOT regexp_matches(h, '\.(lcl|local|lan|corp|internal)$') AND h <> 'example.net' AND NOT ends_with(h, '.example.net')
               AND NOT regexp_matches(h, '^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|22[4-9]\.|2[3-5]\d\.)[\d.]*$') AS public FROM h""",
    "control_chars": r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS sha FROM documents",
    "titled_fingerprints": f"SELECT doc_id, sha1(coalesce(nullif({_BARE.format(t='''coalesce(text, '')''')}, ''), {_BARE.format(t='''coalesce(source, '')''')})) AS fingerprint FROM documents",
    "sender_keys": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN lower(c_name) ELSE lower(c_mktsegment) END AS who FROM customer",
    "letter_keys": rf"""
        WITH b AS (SELECT *, left({_BARE.format(t="coalesce(text, '')")}, 120) AS bare FROM conversations)
        SELECT conv_id, turn, concat_ws(chr(10), lower(role) || '|2024-01-01 10:' || lpad(CAST(turn AS VARCHAR), 2, '0'), CASE WHEN length(bare) >= 20 THEN lower(role) || '|' || bare END) AS keys FROM b""",
    "lines_added": rf"""
        WITH b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
        n AS (SELECT *, array_to_string({_WORDS.format(t="before")}, ' ') AS known FROM b WHERE before IS NOT NULL)
        SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split_regex(text, '\r?\n'),
               lambda x: length(array_to_string({_WORDS.format(t="x")}, ' ')) >= 15 AND NOT contains(known, array_to_string({_WORDS.format(t="x")}, ' '))), lambda x: trim(x, ' ')), chr(10)) AS added FROM n""",
    "first_sentences": r"""
        WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS flat FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, left(coalesce(nullif(regexp_extract(flat, '^(.{30,}?[.!?])(\s|$)', 1), ''), flat), 220) AS first FROM f""",
    "issue_number_forms": "SELECT o_orderkey, 'ОБР-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS number, CAST(o_orderkey AS INTEGER) AS parsed FROM orders",
    "worst_results": "SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '; ' ORDER BY l_returnflag || l_linestatus) AS worst FROM lineitem GROUP BY 1",
    "stopped_sessions": f"""
        WITH {_SIGNUPS}, x AS (SELECT s.event_id, min(p.ts) AS stop FROM s LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = s.user_id AND p.ts >= s.ts GROUP BY 1)
        SELECT event_id, CASE WHEN stop IS NULL THEN 'running' ELSE 'stopped' END AS status, epoch_us(stop) AS finished_at FROM x""",
    "session_times": f"""
        WITH {_SIGNUPS}, t AS (SELECT event_id, epoch_us(ts) // 1000000 AS start, epoch_us(ts + INTERVAL 50 MINUTE) // 1000000 AS stop, epoch_us(TIMESTAMP '{NOW}') // 1000000 AS now FROM s)
        SELECT event_id AS person, CAST(ceil(greatest(0, stop - now) / 60) AS BIGINT) AS minutes_left, CAST(floor((now - start) / 60) AS BIGINT) AS minutes_passed FROM t""",
    "page_marks": """
        WITH l AS (SELECT l_partkey AS book, l_shipdate AS "at", l_orderkey * 100 + l_linenumber AS id, max(l_quantity) AS page FROM lineitem GROUP BY 1, 2, 3)
        SELECT book, id, "at", page, page - lag(page) OVER (PARTITION BY book ORDER BY "at", id) AS delta, CAST(round(least(page / p_size, 1.0) * 100) AS INTEGER) AS percent FROM l LEFT JOIN part ON p_partkey = book""",
    "sections_at": """
        WITH m AS (SELECT o_orderkey, c_nationkey AS n, o_orderkey % 100000 AS page FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT o_orderkey, c_name AS section FROM m ASOF LEFT JOIN customer c ON c.c_nationkey = m.n AND m.page >= c.c_custkey""",
    "answers_checked": rf"""
        WITH c AS (SELECT item_id AS id, list_filter(string_split(text, ' ')[1:4], lambda w: length(w) > 1) AS facts FROM benchmark),
        m AS (SELECT c.id, list_filter(facts, lambda f: NOT contains({_NORM.format(t="coalesce(d.text, '')")}, {_NORM.format(t="f")})) AS missing FROM c LEFT JOIN documents d ON d.doc_id = c.id WHERE len(facts) > 0)
        SELECT id, len(missing) = 0 AS answer_ok, array_to_string(missing, '|') AS missing FROM m""",
    "title_neighbours": rf"""
        WITH s AS (SELECT p_partkey AS id, lower(p_type) AS kind, {_STEMS.format(t="p_name")} AS a, {_STEMS.format(t="'cold widget'")} AS b FROM part),
        x AS (SELECT id, coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0) * CASE WHEN kind IN ('economy', 'other') THEN 1.0 ELSE 0.8 END AS score FROM s)
        SELECT id, round(score, 2) AS score FROM x WHERE score >= 0.75 ORDER BY round(score, 2) DESC, id LIMIT 3""",
    "cached_answers": """
        WITH h AS (SELECT user_id, ts, max(event_id) AS answer FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT e.event_id, CASE WHEN epoch_us(e.ts) // 1000000 - epoch_us(h.ts) // 1000000 <= 3600 THEN answer END AS answer
        FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN h ON h.user_id = e.user_id AND e.ts >= h.ts""",
    "query_words": rf"""
        WITH w AS (SELECT DISTINCT conv_id AS query, unnest({_WORDS.format(t="text")}) AS word FROM conversations)
        SELECT query, string_agg(word, ' | ' ORDER BY encode(word)) AS words FROM w GROUP BY 1""",
    "attachment_budget": """
        WITH f AS (SELECT conv_id AS message, turn AS position, length(text) * 20 AS n, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS again FROM conversations WHERE text IS NOT NULL),
        r AS (SELECT message, position, least(n, 12000) AS n, row_number() OVER (PARTITION BY message ORDER BY position) AS place FROM f WHERE again = 1),
        b AS (SELECT message, position, n, coalesce(sum(n) OVER (PARTITION BY message ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE place <= 10)
        SELECT message, position, CAST(greatest(0, least(n, 30000 - before)) AS BIGINT) AS n FROM b""",
    "articles_published": """
        WITH a AS (SELECT concat_ws(' ', source, lpad(CAST(doc_id AS VARCHAR), 9, '0')) || '.md' AS name, sha256(text) AS sha256, strlen(text) AS size FROM documents WHERE length(trim(text, ' ')) >= 40)
        SELECT min(name) AS name, sha256, CAST(min(size) AS BIGINT) AS size, 'queued' AS status FROM a WHERE sha256 NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de' AND text IS NOT NULL) GROUP BY sha256""",
    "quotes_dedented": r"SELECT doc_id, sha256(regexp_replace(text, '(?m)^(\t| {4}|>\s?)+', '', 'g')) AS sha FROM documents",
    "links_tidied": r"""SELECT page_id, sha256(CASE WHEN contains(html, '<') THEN regexp_replace(regexp_replace(html, '\s*<mailto:[^>]+>\s*', ' ', 'g'), '\s*<(https?://[^>\s]+)>', '', 'g') ELSE html END) AS sha FROM pages""",
    "filenames_cleaned": "SELECT doc_id, regexp_replace(concat_ws('-', left(sha1(text), 8), source, lang), '^[0-9a-f]{8}-', '') AS name FROM documents",
    "object_keys": "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^a-zа-яё0-9_]', '', 'g') AS key FROM part",
    "file_lines": """SELECT doc_id AS position, doc_id || '. ' || concat_ws('.', source, lang) || ' — ' || concat_ws('; ', lang, CASE WHEN length(text) > 500 THEN 'long' END, 'new', '→ add') AS line FROM documents""",
    "settings_put": """
        WITH o AS (SELECT c_custkey AS person, c_nationkey > 10 AS astro FROM customer WHERE c_acctbal > 0),
        n AS (SELECT o_custkey AS person, bool_or(o_totalprice > 200000) AS astro, bool_and(o_orderstatus = 'F') AS stars FROM orders GROUP BY 1)
        SELECT coalesce(o.person, n.person) AS person, coalesce(n.astro, o.astro, true) AS astro, o.person IS NULL AS planets, coalesce(n.stars, true) AS stars FROM o FULL JOIN n ON o.person = n.person""",
}
