"""Writes that go through a ledger, on the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkb.functions import text
from loomkb.operators import acceptance, incremental
from loomkb.operators.ledger import Ledger
from loomkb.plans import registries
from loomkb.session import table
from loomkb.storage import scratch_path


def _accepted(spark, sf_dir):
    """Ledger after two batches of all documents as files: by language, then again by source; the first one is replayed."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    files = d.select(F.col("doc_id").alias("position"), name.alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.length(F.coalesce("text", F.lit(""))).alias("size"), F.lit(False).alias("email"))
    ledger = Ledger(spark, scratch_path(spark, "ledger"))

    def decisions(kind, column):
        contour = F.array(F.struct(F.lit(kind).alias("kind"), F.col(column).alias("name")))
        plain = {"action": F.lit("add"), "contours": F.array().cast("array<bigint>"), "new_contours": contour, "kind": F.lit("text"), "document_id": F.lit(None).cast("long"), "title": F.lit(None).cast("string")}
        return d.select(name.alias("filename"), *[c.alias(k) for k, c in plain.items()])

    acceptance.accept(ledger, "intake", 0, files, decisions("language", "lang"))
    acceptance.accept(ledger, "intake", 1, files, decisions("source", "source"))
    acceptance.accept(ledger, "intake", 0, files, decisions("source", "text"))
    return ledger


def intake_accept(spark, sf_dir):
    seen = acceptance.material_view(_accepted(spark, sf_dir).snapshot())
    return seen.select("id", "filename", "status", "size", F.array_join("contours", "|").alias("contours"))


def intake_receipts(spark, sf_dir):
    at = _accepted(spark, sf_dir).snapshot()
    return at.table("receipts").select("batch", "filename", "material_id", "already", "error")


def thread_ingest(spark, sf_dir):
    """Threads of all conversations whose letters arrive in three batches, by turn; the last one comes twice."""
    worded = F.regexp_like("text", F.lit(r"[\p{L}\p{N}_]"))
    letters = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("chain"), F.when(worded, text.content_fingerprint(F.col("text"))).alias("letter"), "turn")
    ledger = Ledger(spark, scratch_path(spark, "threads"))
    for batch, arrived in enumerate(("turn <= 0", "turn > 0 AND turn <= 2", "turn > 2 OR turn IS NULL")):
        incremental.ingest(ledger, "letters", batch, letters.where(arrived))
    incremental.ingest(ledger, "letters", 2, letters)
    return incremental.threads(ledger.snapshot())[1].select(F.col("chain").alias("conv_id"), F.col("thread").alias("thread_id"))


QUERIES = {"intake_accept": intake_accept, "intake_receipts": intake_receipts, "thread_ingest": thread_ingest}

_MATERIALS = """d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, length(coalesce(text, '')) AS size, lang, source FROM documents),
    f AS (SELECT h, min(doc_id) AS first FROM d GROUP BY h), m AS (SELECT h, first, row_number() OVER (ORDER BY first) AS id FROM f)"""
ORACLES = {
    "thread_ingest": registries.ORACLES["thread_merge"],
    "intake_accept": f"""
        WITH {_MATERIALS}, c AS (SELECT h, trim(lang) AS name FROM d UNION SELECT h, trim(source) FROM d),
        n AS (SELECT h, string_agg(DISTINCT name, '|' ORDER BY name) AS contours FROM c WHERE name <> '' GROUP BY h)
        SELECT m.id, 'doc-' || d.doc_id AS filename, 'queued' AS status, d.size, n.contours FROM m JOIN d ON d.doc_id = m.first LEFT JOIN n ON n.h = m.h""",
    "intake_receipts": f"""
        WITH {_MATERIALS}
        SELECT 'intake/' || b AS batch, 'doc-' || d.doc_id AS filename, m.id AS material_id, b = 1 OR d.doc_id <> m.first AS already, CAST(NULL AS VARCHAR) AS error
        FROM d JOIN m USING (h), (VALUES (0), (1)) AS t(b)""",
}
