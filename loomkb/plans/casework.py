"""Letters, issues, materials and documents on the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkb.operators import chunks, issues, letters, library
from loomkb.session import table

BASE = "2024-01-01 00:00:00"


def _letters(spark, sf_dir):
    """Turns as letters: one sender for each role of a conversation, 61 minutes apart."""
    seconds = F.unix_timestamp(F.lit(BASE).cast("timestamp")) + F.col("conv_id") * 86400 + F.col("turn") * 3660
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("letter"),
        F.col("conv_id").alias("thread"),
        F.concat("role", F.col("conv_id").cast("string")).alias("sender_key"),
        F.col("role").alias("sender"),
        F.timestamp_seconds(seconds).alias("sent_at"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("message_id"),
        F.when(F.col("turn") % 2 == 0, F.lit("file")).otherwise(F.lit("quoted")).alias("origin"),
    )


def known_letters(spark, sf_dir):
    """Every letter comes again from another time zone, without its last word."""
    stored = _letters(spark, sf_dir)
    again = stored.withColumns({"letter": F.col("letter") + 10**9, "sent_at": F.col("sent_at") + F.expr("INTERVAL 3 HOURS"), "body": F.regexp_replace("body", r"[^\p{L}\p{N}_]*[\p{L}\p{N}_]+[^\p{L}\p{N}_]*$", "")})
    return letters.known_letters(again, stored)


def thread_summaries(spark, sf_dir):
    return letters.thread_summaries(_letters(spark, sf_dir)).select("thread", "letters", "problem", "last", "participants")


def thread_letters(spark, sf_dir):
    rows = letters.thread_letters(_letters(spark, sf_dir))
    return rows.select("thread", F.array_join(F.transform("letters", lambda r: r["letter"].cast("string")), ",").alias("letters"))


def summary_input(spark, sf_dir):
    return letters.summary_input(_letters(spark, sf_dir), 1500)


def corpus_letters(spark, sf_dir):
    return chunks.corpus_letters(_letters(spark, sf_dir).select("letter", "origin", F.array(F.sha1("body")).alias("keys")))


def issue_initiators(spark, sf_dir):
    role = F.when(F.col("sender") == "assistant", "internal").when(F.col("sender") == "user", "external").otherwise("analyst")
    rows = _letters(spark, sf_dir).withColumns({"chain": F.col("thread"), "role": role})
    return issues.initiators(rows.select("chain", "letter", "sender_key", "sent_at", "origin", "role"))


def _issue_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("contact")
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("organization"))
    l = table(spark, sf_dir, "lineitem").withColumn("n", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    a = l.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("issue"), F.col("l_returnflag").alias("filename"), F.col("l_quantity").alias("size"))
    none = F.lit(None).cast("string")
    e = l.select(
        F.col("l_orderkey").alias("issue"), F.col("l_shipdate").alias("at"), F.col("n").alias("seq"), F.col("l_linestatus").alias("actor"),
        F.when(F.col("l_returnflag") == "R", "comment").otherwise("status").alias("type"), none.alias("field"), none.alias("old_value"), none.alias("new_value"), F.col("l_quantity").cast("long").cast("string").alias("comment"),
    )
    return o, c, a, e


def issue_cards(spark, sf_dir):
    cards = issues.cards(*_issue_tables(spark, sf_dir))
    return cards.select("id", F.col("initiator.name").alias("initiator"), F.coalesce(F.size("attachments"), F.lit(0)).cast("long").alias("files"), F.get("events", F.lit(0))["comment"].alias("first_event"))


def issue_short_cards(spark, sf_dir):
    short = issues.short_card(issues.cards(*_issue_tables(spark, sf_dir)))
    return short.select("id", "number", "initiator", F.array_join("comments", "|").alias("comments"))


def attachment_append(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("issue"), F.sha2(F.concat("l_returnflag", "l_linestatus"), 256).alias("sha256"), F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("filename"))
    return issues.attach(files.where("filename LIKE '1-%'"), files)


def contour_paths(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent_id"))
    chosen = F.array((F.col("c_nationkey") + 100).cast("long"), (F.col("c_custkey") % 5).cast("long"))
    return issues.contour_paths(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), chosen.alias("contours")), region.unionByName(nation))


def alias_clean(spark, sf_dir):
    values = F.array("c_mktsegment", F.lower("c_mktsegment"), F.concat(F.lit("  "), "c_name"), F.lit(" "), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(library.clean_aliases(values), "|").alias("aliases"))


def material_states(spark, sf_dir):
    kinds = {"signup": "queued", "view": "parsing", "click": "done", "purchase": "error", "logout": "deleted"}
    e = table(spark, sf_dir, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()], F.lit("graph"))
    log = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), status.alias("status"), F.col("event_type").alias("detail"))
    states = library.material_states(log.select("id", F.lit("new").alias("status")).distinct(), log)
    return library.recover(states).select("id", "status", "detail", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_at"), F.unix_micros(F.col("finished_at").cast("timestamp")).alias("finished_at"))


def _doc_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("material"), F.concat_ws("/", "source", "lang").alias("source"), F.col("lang").alias("title"), F.sha1(F.coalesce("text", F.lit(""))).alias("chunk_id"), "doc_id")


def batch_outcomes(spark, sf_dir):
    c = _doc_chunks(spark, sf_dir)
    known = c.where("doc_id % 2 = 0 OR material = 'src3'")
    return library.batch_outcomes(c.select(F.col("material").alias("id")).distinct().unionByName(spark.createDataFrame([("nothing",)], "id string")), c, known)


def register_documents(spark, sf_dir):
    c = _doc_chunks(spark, sf_dir)
    return library.register_documents(c, c.where("doc_id % 3 = 0")).select("source", "title", F.size("chunk_ids").cast("long").alias("chunks"), "first")


def register_uploads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("filename"), F.lit("{}").alias("decision"))
    first = d.groupBy("sha256").agg(F.min("id").alias("id")).where("id % 3 = 0").withColumn("status", F.when(F.col("id") % 2 == 0, "deleted").otherwise("done"))
    fresh, again, seen = library.register_uploads(first, d.drop("id"))
    rows = [fresh.select("sha256", F.lit("new").alias("what")), again.select("sha256", F.lit("again").alias("what")), seen.select("sha256", F.lit("seen").alias("what"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def upload_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("arrival"), F.col("p_brand").alias("day"), F.concat(F.regexp_replace("p_type", " ", "_"), F.lit(".txt")).alias("filename"))
    return library.upload_names(p).select("arrival", "path")


def document_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("title"))
    docs = d.groupBy("title").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("current_version")).withColumn("updated_at", F.col("current_version"))
    versions = d.join(docs.select("id", "title"), "title").select(F.col("id").alias("document"), F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("version_label"), F.col("title").alias("filename"))
    return library.document_list(docs, versions, "en").select("id", "title", "version_label", "versions")


def document_versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    versions = d.select(F.col("source").alias("document"), F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("version_label"), F.lit("f").alias("filename"))
    nested = library.with_versions(d.select(F.col("source").alias("id")).distinct(), versions)
    return nested.select("id", F.array_join(F.transform("versions", lambda v: v["version_label"]), ",").alias("versions"))


def document_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("doc_id").cast("string").alias("source"), F.concat_ws("/", "lang", "source").alias("doc_title"), F.lit("1").alias("version"), F.lit("doc").alias("doc_type"),
        F.lit("1").alias("section"), F.lit("Текст").alias("title"), F.split(F.coalesce("text", F.lit("")), "\n").alias("paragraphs"),
    )
    return chunks.section_chunks(rows).select("chunk_id", "source", "title", "text")


def chunk_upsert(spark, sf_dir):
    made = document_chunks(spark, sf_dir).withColumns({"doc_type": F.lit("doc"), "objects": F.array().cast("array<string>"), "attrs": F.create_map().cast("map<string,string>")})
    have = made.where(F.col("source").cast("long") % 2 == 0)
    return chunks.upsert_chunks(have, made).select("chunk_id", "source", "status", F.size("embedding").alias("dim"))


def message_chunks(spark, sf_dir):
    rows = _letters(spark, sf_dir).withColumns({"source": F.col("letter").cast("string"), "subject": F.lit("Re: тема"), "sender_email": F.lit("a@corp.example"), "to": F.lit("Анна <b@corp.example>"), "cc": F.lit(None).cast("string"), "attachments": F.array().cast("array<string>")})
    return chunks.message_chunks(rows).select("chunk_id", "source", "text")


def corpus_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    paragraphs = d.select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return chunks.corpus_report(d.select("doc_id"), paragraphs, table(spark, sf_dir, "labels").select("doc_id"))


QUERIES = {
    f.__name__: f
    for f in (
        known_letters, thread_summaries, thread_letters, summary_input, corpus_letters, issue_initiators, issue_cards, issue_short_cards, attachment_append,
        contour_paths, alias_clean, material_states, batch_outcomes, register_documents, register_uploads, upload_names, document_list, document_versions,
        document_chunks, chunk_upsert, message_chunks, corpus_report,
    )
}

_LETTERS = f"""
letters AS (SELECT conv_id * 1000 + turn AS letter, conv_id AS thread, role || conv_id AS sender_key, role AS sender,
            epoch(TIMESTAMP '{BASE}') + conv_id * 86400 + turn * 3660 AS sent_at, text AS body, CASE WHEN turn % 2 = 0 THEN 'file' ELSE 'quoted' END AS origin FROM conversations)"""
_SHINGLES = r"""(CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < 3 THEN [array_to_string({w}, ' ')]
              ELSE list_distinct(list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i + 2], ' '))) END)"""
_WORDS = r"regexp_extract_all(translate(lower({t}), 'ё', 'е'), '[\p{L}\p{N}_]+')"
_LEAD = r"""(CASE WHEN length(trim(regexp_replace({b}, '[\s\p{Z}\x{85}]+', ' ', 'g'))) > 300 THEN left(trim(regexp_replace({b}, '[\s\p{Z}\x{85}]+', ' ', 'g')), 300) || '…'
            ELSE trim(regexp_replace({b}, '[\s\p{Z}\x{85}]+', ' ', 'g')) END)"""
_CHUNKS = "c AS (SELECT source AS material, source || '/' || lang AS source, lang AS title, sha1(coalesce(text, '')) AS chunk_id, doc_id FROM documents)"

ORACLES = {
    "known_letters": f"""
        WITH {_LETTERS},
        w AS (SELECT letter, sender_key, sent_at, {_WORDS.replace('{t}', 'body')} AS w FROM letters),
        o AS (SELECT letter, sender_key, sent_at, {_SHINGLES.replace('{w}', 'w')} AS s FROM w),
        v AS (SELECT letter + 1000000000 AS letter, sender_key, sent_at + 10800 AS sent_at, w[1:len(w) - 1] AS w FROM w),
        n AS (SELECT letter, sender_key, sent_at, {_SHINGLES.replace('{w}', 'w')} AS s FROM v),
        p AS (SELECT n.letter, o.letter AS known, abs(n.sent_at - o.sent_at) AS apart, len(list_intersect(n.s, o.s)) / least(len(n.s), len(o.s)) AS score
              FROM n JOIN o ON n.sender_key = o.sender_key AND abs(n.sent_at - o.sent_at) <= 50400 AND len(n.s) > 0 AND len(o.s) > 0),
        q AS (SELECT letter, known, score, row_number() OVER (PARTITION BY letter ORDER BY score DESC, known) AS rn FROM p
              WHERE score >= CASE WHEN apart % 3600 <= 120 OR 3600 - apart % 3600 <= 120 THEN 0.4 ELSE 0.75 END)
        SELECT n.letter, q.known, round(q.score, 9) AS score FROM n LEFT JOIN q ON q.letter = n.letter AND rn = 1""",
    "thread_summaries": f"""
        WITH {_LETTERS}, f AS (SELECT thread, count(*) AS letters, arg_min(body, sent_at) AS fb, arg_max(body, sent_at) AS lb, arg_max(sender, sent_at) AS ls,
               array_to_string(list_sort(list(DISTINCT sender)), ', ') AS participants FROM letters GROUP BY thread)
        SELECT thread, letters, {_LEAD.replace('{b}', 'fb')} AS problem, CASE WHEN letters > 1 THEN ls || ': ' || {_LEAD.replace('{b}', 'lb')} ELSE '' END AS last, participants FROM f""",
    "thread_letters": "SELECT conv_id AS thread, string_agg(CAST(conv_id * 1000 + turn AS VARCHAR), ',' ORDER BY turn) AS letters FROM conversations GROUP BY conv_id",
    "summary_input": f"""
        WITH {_LETTERS}, t AS (SELECT thread, string_agg('— ' || sender || ', ' || strftime(to_timestamp(sent_at) AT TIME ZONE 'UTC', '%d.%m.%Y %H:%M') || ':' || chr(10) || trim(body, ' '), chr(10) || chr(10) ORDER BY sent_at) AS t
               FROM letters GROUP BY thread)
        SELECT thread, CASE WHEN length(t) > 1500 THEN '…' || chr(10) || right(t, 1500) ELSE t END AS input FROM t""",
    "corpus_letters": f"WITH {_LETTERS} SELECT letter, first_value(letter) OVER (PARTITION BY body ORDER BY origin <> 'file', letter) AS canonical FROM letters",
    "issue_initiators": f"""
        WITH {_LETTERS}, r AS (SELECT thread AS chain, letter, sent_at, CASE sender WHEN 'assistant' THEN 1 WHEN 'user' THEN 3 END AS rank FROM letters),
        b AS (SELECT chain, letter, rank, row_number() OVER (PARTITION BY chain ORDER BY rank, sent_at DESC, letter DESC) AS rn FROM r WHERE rank IS NOT NULL)
        SELECT c.chain, b.letter, CASE WHEN b.rank = 1 THEN 'high' WHEN b.rank = 3 THEN 'low' ELSE 'none' END AS confidence FROM (SELECT DISTINCT chain FROM r) c LEFT JOIN b ON b.chain = c.chain AND rn = 1""",
    "issue_cards": """
        WITH a AS (SELECT l_orderkey AS id, count(*) AS files FROM lineitem GROUP BY 1),
        e AS (SELECT l_orderkey AS id, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
        SELECT o_orderkey AS id, c_name AS initiator, coalesce(files, 0) AS files, e.c AS first_event FROM orders LEFT JOIN customer ON c_custkey = o_custkey
        LEFT JOIN a ON a.id = o_orderkey LEFT JOIN e ON e.id = o_orderkey AND rn = 1""",
    "issue_short_cards": """
        WITH e AS (SELECT l_orderkey AS id, strftime(l_shipdate, '%Y-%m-%d') || ' ' || l_linestatus || ': ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS c,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem WHERE l_returnflag = 'R'),
        l AS (SELECT id, string_agg(c, '|' ORDER BY rn DESC) AS comments FROM e WHERE rn <= 5 GROUP BY id)
        SELECT o_orderkey AS id, 'ОБР-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS number, concat_ws(' · ', c_name, c_mktsegment) AS initiator, coalesce(comments, '') AS comments
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l.id = o_orderkey""",
    "attachment_append": """
        WITH f AS (SELECT l_orderkey AS issue, sha256(l_returnflag || l_linestatus) AS sha256, l_linenumber || '-' || l_partkey AS filename FROM lineitem),
        n AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f k WHERE k.issue = f.issue AND k.sha256 = f.sha256 AND k.filename LIKE '1-%'))
        SELECT issue, sha256, min(filename) AS filename FROM n GROUP BY ALL""",
    "contour_paths": """
        WITH r AS (SELECT c_custkey AS id, r.r_name || ' › ' || n_name AS nation, r.r_regionkey AS home, c_custkey % 5 AS other FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n_regionkey)
        SELECT r.id, CASE WHEN home = other THEN nation ELSE array_to_string(list_sort([nation, o.r_name]), '; ') END AS system FROM r JOIN region o ON o.r_regionkey = r.other""",
    "alias_clean": "SELECT c_custkey, c_mktsegment || '|' || c_name AS aliases FROM customer",
    "material_states": """
        WITH l AS (SELECT user_id AS id, event_id, ts, event_type, coalesce(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'error' WHEN 'logout' THEN 'deleted' END, 'graph') AS s FROM events)
        SELECT id, CASE WHEN arg_max(s, event_id) IN ('parsing', 'indexing', 'graph') THEN 'queued' ELSE arg_max(s, event_id) END AS status, arg_max(event_type, event_id) AS detail,
               epoch_us(max(ts) FILTER (s = 'parsing')) AS started_at, epoch_us(max(ts) FILTER (s IN ('done', 'duplicate', 'error', 'deleted'))) AS finished_at FROM l GROUP BY id""",
    "batch_outcomes": f"""
        WITH {_CHUNKS}, k AS (SELECT DISTINCT chunk_id FROM c WHERE doc_id % 2 = 0 OR material = 'src3'),
        n AS (SELECT material AS id, count(*) AS chunks, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM k)) AS new FROM c GROUP BY 1 UNION ALL SELECT 'nothing', 0, 0)
        SELECT id, chunks, new, CASE WHEN chunks = 0 THEN 'error' WHEN new = 0 THEN 'duplicate' ELSE 'done' END AS status FROM n""",
    "register_documents": f"""
        WITH {_CHUNKS}, f AS (SELECT * FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE doc_id % 3 = 0)),
        d AS (SELECT material, source, min(title) AS title, count(DISTINCT chunk_id) AS chunks FROM f GROUP BY 1, 2)
        SELECT source, title, chunks, row_number() OVER (PARTITION BY material ORDER BY source) = 1 AS first FROM d""",
    "register_uploads": """
        WITH d AS (SELECT sha256(text) AS sha256, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY 1)
        SELECT sha256, CASE WHEN id % 3 <> 0 THEN 'new' WHEN id % 2 = 0 THEN 'again' ELSE 'seen' END AS what FROM d""",
    "upload_names": """
        WITH p AS (SELECT p_partkey AS arrival, p_brand AS b, replace(p_type, ' ', '_') AS t, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) AS n FROM part)
        SELECT arrival, b || '/' || t || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.txt' AS path FROM p""",
    "document_list": """
        SELECT min(doc_id) AS id, lang || '/' || source AS title, CAST(max(doc_id) AS VARCHAR) AS version_label, count(*) AS versions FROM documents
        WHERE contains(lower(lang || '/' || source), 'en') GROUP BY lang, source ORDER BY max(doc_id) DESC LIMIT 200""",
    "document_versions": "SELECT source AS id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS versions FROM documents GROUP BY source",
    "corpus_report": """
        WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), l AS (SELECT doc_id, count(*) AS c FROM labels GROUP BY 1),
        a AS (SELECT d.doc_id, coalesce(p.n, 0) AS sections, coalesce(l.c, 0) AS cases FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id))
        SELECT doc_id, CAST(sections AS BIGINT) AS sections, CAST(cases AS BIGINT) AS cases FROM a UNION ALL SELECT NULL, CAST(sum(sections) AS BIGINT), CAST(sum(cases) AS BIGINT) FROM a""",
}
