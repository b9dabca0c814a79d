"""Intake as one transaction: files with their decisions, new contours, entities and registries, issues with their first events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkb.operators import issues as issue_ops
from loomkb.operators.ledger import VERSION, Ledger, Snapshot, latest
from loomkb.operators.registry import consecutive
from loomkb.storage import materialize

# What may be done with a file, and how it then stands in the queue.
STATUS_OF = {"add": "queued", "new_version": "queued", "archive": "archived"}

CONTOURS = "id long, kind string, name string"
MATERIALS = "id long, filename string, sha256 string, size long, status string, kind string, document_id long, title string"
LINKS = "material_id long, contour long"
RECEIPTS = "batch string, filename string, material_id long, already boolean, error string"


def _top(rows: DataFrame) -> Column:
    """The largest id so far, as a value for another plan."""
    return rows.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()


def accepted(before: Snapshot, files: DataFrame, decisions: DataFrame, batch: str) -> dict[str, DataFrame]:
    """Rows to append for files (position, filename, sha256, size, email) and decisions (filename, action, contours, new_contours, kind, document_id, title).

    Documents come before e-mails, then by position: of equal contents the first
    is registered. Content that is known already gets no new row; its decision's
    contours are added to it, and so to its chunks and threads. New contours
    (kind, name) are made once, or found by name whatever its case. A file
    without a decision is added; "skip" leaves it out; an unknown action, and a
    new contour without a kind, are errors of that file, and receipts say so.
    """
    plan = decisions.dropDuplicates(["filename"])
    both = files.join(plan, "filename", "left").withColumn("action", F.coalesce("action", F.lit("add")))
    wrong = F.when(~F.col("action").isin(*STATUS_OF, "skip"), F.concat(F.lit("unknown action: "), "action"))
    named = F.filter(F.coalesce("new_contours", F.array().cast("array<struct<kind:string,name:string>>")), lambda c: F.trim(F.coalesce(c["name"], F.lit(""))) != "")
    unkind = F.when(F.exists(named, lambda c: F.coalesce(c["kind"], F.lit("")) == ""), F.lit("a new contour needs a kind"))
    both = materialize(both.withColumns({"new_contours": named, "error": F.coalesce(wrong, unkind)}), "decided")
    wanted = both.where("error IS NULL AND action <> 'skip'")

    old_contours = before.table("contours", CONTOURS)
    asked = wanted.select("position", F.posexplode("new_contours").alias("__i", "c")).select("position", "__i", "c.kind", F.trim("c.name").alias("name"))
    folded = lambda df: df.withColumn("__k", F.lower("name"))
    fresh = folded(asked).join(folded(old_contours).select("kind", "__k"), ["kind", "__k"], "left_anti")
    fresh = fresh.groupBy("kind", "__k").agg(F.min_by("name", F.struct("position", "__i")).alias("name"), F.min(F.struct("position", "__i")).alias("__at"))
    contours = consecutive(fresh, ["__at", "kind"], "id", _top(old_contours)).select("id", "kind", "name")
    contours = materialize(contours, "contours")
    known = folded(old_contours.select("id", "kind", "name").unionByName(contours)).groupBy("kind", "__k").agg(F.min("id").alias("contour"))

    old = before.table("materials", MATERIALS)
    seen = old.groupBy("sha256").agg(F.min("id").alias("known_id"))
    rank = F.struct(F.coalesce("email", F.lit(False)).alias("e"), "position")
    firsts = wanted.groupBy("sha256").agg(F.min_by(F.struct("filename", "size", "action", "kind", "document_id", "title"), rank).alias("f"), F.min(rank).alias("__at"))
    new = consecutive(firsts.join(seen, "sha256", "left_anti"), ["__at"], "id", _top(old))
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])[F.col("f.action")]
    document = F.when(F.col("f.action") == "new_version", F.col("f.document_id"))
    materials = new.select("id", "f.filename", "sha256", F.col("f.size").cast("long").alias("size"), status.alias("status"), "f.kind", document.cast("long").alias("document_id"), "f.title")
    materials = materialize(materials, "materials")
    numbers = old.select("sha256", "id").unionByName(materials.select("sha256", "id")).groupBy("sha256").agg(F.min("id").alias("material_id"))

    chosen = wanted.select("sha256", F.explode("contours").alias("contour"))
    made = folded(wanted.select("sha256", F.explode("new_contours").alias("c")).select("sha256", "c.kind", F.trim("c.name").alias("name")))
    pairs = chosen.unionByName(made.join(known, ["kind", "__k"]).select("sha256", "contour")).join(numbers, "sha256").select("material_id", F.col("contour").cast("long").alias("contour")).distinct()
    links = pairs.join(before.table("material_contours", LINKS), ["material_id", "contour"], "left_anti")

    first_at = firsts.select("sha256", F.col("__at.position").alias("__first"))
    receipts = both.join(numbers, "sha256", "left").join(first_at, "sha256", "left").join(seen, "sha256", "left")
    again = F.col("known_id").isNotNull() | (F.col("position") != F.col("__first"))
    taken = F.col("error").isNull() & (F.col("action") != "skip")
    receipts = receipts.select(F.lit(batch).alias("batch"), "filename", F.when(taken, F.col("material_id")).alias("material_id"), F.when(taken, again).alias("already"), "error")
    return {"contours": contours, "materials": materials, "material_contours": links, "receipts": receipts}


def accept(ledger: Ledger, application: str, batch: int, files: DataFrame, decisions: DataFrame) -> int:
    """Register a batch of files with all that hangs on it, at once or not at all; a replayed batch does nothing."""
    return ledger.commit(application, batch, lambda before: accepted(before, files, decisions, f"{application}/{batch}"))


def material_view(at: Snapshot) -> DataFrame:
    """Materials with the names of their contours, in order."""
    contours = at.table("contours", CONTOURS).select(F.col("id").alias("contour"), "name")
    links = at.table("material_contours", LINKS).select("material_id", "contour").distinct().join(contours, "contour")
    named = links.groupBy(F.col("material_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("contours"))
    return at.table("materials", MATERIALS).drop(VERSION).join(named, "id", "left")


def with_contours(rows: DataFrame, links: DataFrame, key: str = "material_id", column: str = "contours") -> DataFrame:
    """``rows`` (chunks by material, or threads by the materials of their letters) with the contours of ``links`` (key, contour) united into theirs."""
    added = links.groupBy(key).agg(F.collect_set("contour").alias("__added"))
    none = F.array().cast("array<bigint>")
    united = F.array_sort(F.array_distinct(F.concat(F.coalesce(column, none), F.coalesce("__added", none))))
    return rows.join(added, key, "left").withColumn(column, united).drop("__added")


def learned(before: Snapshot, entities: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """Rows to append for entities (key, kind, name, attrs, chunk) and relations (src, rel, dst, source_chunk) of parsed chunks.

    An entity's attributes are merged when it is read (``entity_state``); mentions and relations are kept once.
    """
    old_mentions = before.table("mentions", "key string, chunk string")
    mentions = entities.where("chunk IS NOT NULL").select("key", "chunk").distinct().join(old_mentions, ["key", "chunk"], "left_anti")
    old = before.table("relations", "src string, rel string, dst string, source_chunk string")
    ends = ["src", "rel", "dst", "source_chunk"]
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ends]
    fresh = relations.select(*ends).distinct().alias("n").join(old.alias("o"), same, "left_anti")
    return {"entities": entities.select("key", "kind", "name", "attrs"), "mentions": mentions, "relations": fresh}


def entity_state(at: Snapshot) -> DataFrame:
    """Entities: kind and name as first met, attributes with the last value of each."""
    return latest(at.table("entities"), ["key"], merge=["attrs"])


def registered(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows to append of test_cases, requirements and requirement_tests of a document."""
    return {name: rows for name, rows in tables.items() if name in REGISTRIES}


#: Keys of the registries, and the columns that a later row changes.
REGISTRIES = {
    "test_cases": (["project", "doc", "num"], ["steps", "result"]),
    "requirements": (["project", "req_id", "doc"], ["text", "objects"]),
    "requirement_tests": (["project", "req_id", "doc", "test_doc", "test_num"], []),
}


def registry_state(at: Snapshot, name: str) -> DataFrame:
    keys, changed = REGISTRIES[name]
    return latest(at.table(name), keys, update=changed)


ISSUES = "id long, title string, status string, message_id string, draft long, resolved_at timestamp"


def open_issues(ledger: Ledger, application: str, batch: int, drafts: DataFrame, now: Column, actor: str | None = None) -> int:
    """Register drafts (draft, title, status, message_id) as issues with their first events: numbers go on without gaps or repeats, whoever else writes."""

    def change(before: Snapshot) -> dict[str, DataFrame]:
        old = before.table("issues", ISSUES).drop(VERSION)
        rows, events, _ = issue_ops.create(old, drafts, now, actor)
        columns = [c.split()[0] for c in ISSUES.split(", ")]
        rows = materialize(rows.select(*columns), "issues")
        return {"issues": rows, "events": events}

    return ledger.commit(application, batch, change)
