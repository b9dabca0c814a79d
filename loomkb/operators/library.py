"""Materials, documents, contours and evaluation as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.functions import text
from loomkb.operators import registry

FINISHED = ("done", "duplicate", "error", "deleted")
RESTORED = ("deleted", "archived")
CASES = "id string, question string, evidence array<string>, answer_must_contain array<string>, filters map<string,string>"


def register_uploads(materials: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to append, rows that wait again, rows already there) of uploads (filename, sha256, size, decision).

    Content that was deleted or archived is queued again with the new decision;
    any other known content is returned as it is.
    """
    once = registry.first_of(incoming, ["sha256"], [F.col("filename")])
    known = once.join(materials.select(F.col("id"), "sha256", F.col("status").alias("was")), "sha256")
    gone = F.col("was").isin(*RESTORED)
    fresh = once.join(materials.select("sha256"), "sha256", "left_anti")
    fresh = fresh.withColumns({"filename": text.safe_filename(F.col("filename")), "status": F.lit("queued")})
    again = known.where(gone).select("id", "sha256", "decision", F.lit("queued").alias("status"), F.col("was"))
    return fresh, again, known.where(~gone).select("id", "sha256", "was")


def upload_names(incoming: DataFrame, folder: str = "day") -> DataFrame:
    """``incoming`` with ``path``: a name that a folder already has gets a number, by (arrival)."""
    from pyspark.sql import Window

    name = text.safe_filename(F.col("filename"))
    n = F.row_number().over(Window.partitionBy(folder, F.lower("__name")).orderBy("arrival"))
    stem, dot = F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 2)
    numbered = F.when(F.col("__n") == 1, F.col("__name")).otherwise(F.concat(stem, F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), dot))
    return incoming.withColumn("__name", name).withColumn("__n", n).withColumn("path", F.concat_ws("/", F.col(folder).cast("string"), numbered)).drop("__name", "__n")


def material_states(materials: DataFrame, events: DataFrame) -> DataFrame:
    """(id, status, detail, started_at, finished_at): state after all status events (id, seq, at, status, detail); one aggregation."""
    last = events.groupBy("id").agg(
        F.max_by(F.struct("status", "detail"), "seq").alias("s"),
        F.max(F.when(F.col("status") == "parsing", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*FINISHED), F.col("at"))).alias("finished_at"),
    )
    out = materials.select("id", F.col("status").alias("__first")).join(last, "id", "left")
    return out.select("id", F.coalesce("s.status", "__first").alias("status"), F.col("s.detail").alias("detail"), "started_at", "finished_at")


def recover(states: DataFrame) -> DataFrame:
    """Materials that a crash left half done go back into the queue."""
    return states.withColumn("status", F.when(F.col("status").isin("parsing", "indexing", "graph"), F.lit("queued")).otherwise(F.col("status")))


def batch_outcomes(materials: DataFrame, chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(id, chunks, new, status): error where a material gave nothing, duplicate where all was known, else done."""
    marked = chunks.join(known.select("chunk_id").distinct().withColumn("__known", F.lit(True)), "chunk_id", "left")
    counts = marked.groupBy(F.col("material").alias("id")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("__known").isNull()).alias("new"))
    out = materials.select("id").join(counts, "id", "left").fillna(0, ["chunks", "new"])
    return out.withColumn("status", F.when(F.col("chunks") == 0, "error").when(F.col("new") == 0, "duplicate").otherwise("done"))


def register_documents(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(source, title, chunk_ids, first): documents that brought chunks not known before; the first of each material takes its decision."""
    from pyspark.sql import Window

    fresh = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti")
    docs = fresh.groupBy("material", "source").agg(F.min("title").alias("title"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return docs.withColumn("first", F.row_number().over(Window.partitionBy("material").orderBy("source")) == 1)


def where_already(documents: DataFrame, path: str) -> DataFrame:
    """(title, source) of documents that a file also brings but that another one owns."""
    inside = lambda s: (s == path) | F.startswith(s, F.lit(path + "#"))
    return documents.where(F.exists("aliases", inside) & ~inside(F.col("source"))).select("title", "source")


def with_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents with their versions nested, by number."""
    nested = versions.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("id", "version_label", "filename"))).alias("versions"))
    return documents.join(nested, documents["id"] == nested["document"], "left").drop("document")


def document_list(documents: DataFrame, versions: DataFrame, q: str | None = None, limit: int = 200) -> DataFrame:
    """Documents with their current version and number of versions, those with ``q`` in the title, latest change first."""
    counts = versions.groupBy(F.col("document").alias("id")).agg(F.count(F.lit(1)).alias("versions"))
    current = versions.select(F.col("id").alias("current_version"), "version_label", F.col("filename").alias("current_filename"))
    named = documents if q is None else documents.where(F.contains(F.lower("title"), F.lit(q.lower())))
    out = named.join(current, "current_version", "left").join(counts, "id", "left").fillna(0, ["versions"])
    return out.orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(limit)


def similar_titles(documents: DataFrame, title: str, kind: str | None = None, limit: int = 3) -> DataFrame:
    """(id, score) of at most three documents whose titles share three quarters of their stems; another kind counts 0.8."""
    score = F.coalesce(text.overlap(text.title_stems(F.col("title")), text.title_stems(F.lit(title))), F.lit(0.0))
    if kind and kind != "other":
        score = score * F.when(F.col("kind").isin(kind, "other"), F.lit(1.0)).otherwise(F.lit(0.8))
    scored = documents.withColumn("score", score).where(F.col("score") >= 0.75)
    return scored.select("id", F.round("score", 2).alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


def clean_aliases(values: Column) -> Column:
    """Trimmed aliases of at most 200 characters, each once whatever its case, in their order."""
    trimmed = F.filter(F.transform(F.coalesce(values, F.array()), lambda v: F.trim(v)), lambda v: v != "")

    def distinct(rows: Column) -> Column:
        low = F.transform(rows, lambda v: F.lower(v))
        return F.filter(rows, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)

    return F.transform(text.bind(trimmed, distinct), lambda v: F.left(v, F.lit(200)))


def add_contours(contours: DataFrame, incoming: DataFrame, kinds: Sequence[str] = ("system", "subsystem")) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected with error) of contours (kind, name, parent_id, aliases).

    Kinds are given, names are not empty, a subsystem has a parent, parents
    exist, and kind, parent and name together are new whatever their case.
    """
    named = incoming.withColumns({"name": F.left(F.trim(F.coalesce("name", F.lit(""))), F.lit(200)), "aliases": clean_aliases(F.col("aliases"))})
    parents = contours.select(F.col("id").alias("parent_id"), F.lit(True).alias("__parent"))
    same = contours.select("kind", F.coalesce("parent_id", F.lit(-1)).alias("__p"), F.lower("name").alias("__l")).distinct().withColumn("__same", F.lit(True))
    checked = named.join(parents, "parent_id", "left").withColumns({"__p": F.coalesce("parent_id", F.lit(-1)), "__l": F.lower("name")}).join(same, ["kind", "__p", "__l"], "left")
    error = (
        F.when(~F.col("kind").isin(*kinds), "kind")
        .when(F.col("name") == "", "name")
        .when((F.col("kind") == "subsystem") & F.col("parent_id").isNull(), "parent missing")
        .when(F.col("parent_id").isNotNull() & F.col("__parent").isNull(), "parent unknown")
        .when(F.col("__same").isNotNull(), "exists")
    )
    checked = checked.withColumn("error", error)
    good = checked.where("error IS NULL").dropDuplicates(["kind", "__p", "__l"]).select(*incoming.columns)
    return good, checked.where("error IS NOT NULL").select(*incoming.columns, "error")


def update_contours(contours: DataFrame, changes: DataFrame) -> DataFrame:
    """State after partial changes (id, name, aliases, parent_id; null: as it is); an empty name or itself as parent changes nothing."""
    new = changes.select("id", F.nullif(F.left(F.trim("name"), F.lit(200)), F.lit("")).alias("__name"), "aliases", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")).alias("__parent"))
    new = new.withColumn("__aliases", F.when(F.col("aliases").isNotNull(), clean_aliases(F.col("aliases")))).drop("aliases")
    out = contours.join(new, "id", "left")
    return out.select(*[F.coalesce(f"__{'parent' if c == 'parent_id' else c}", c).alias(c) if c in ("name", "aliases", "parent_id") else F.col(c) for c in contours.columns])


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions of a JSON array."""
    return spark.read.schema(CASES).json(path, multiLine=True)


def check_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, answer_ok, missing): which of the facts that an answer must contain it lacks, compared without case, quotes and spacing."""
    both = cases.where("size(answer_must_contain) > 0").join(answers, "id", "left").withColumn("__a", text.eval_norm(F.coalesce("answer", F.lit(""))))
    missing = F.filter("answer_must_contain", lambda fact: ~F.contains(F.col("__a"), text.eval_norm(fact)))
    return both.select("id", missing.alias("missing")).withColumn("answer_ok", F.size("missing") == 0)


def eval_report(results: DataFrame) -> DataFrame:
    """One ``line`` for all results (id, retrieval_hit, answer_ok, error) and one for each that failed, in order of ``place``."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 3)
    first = results.agg(F.count(F.lit(1)).alias("n"), share("retrieval_hit").alias("r"), share("answer_ok").alias("a"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("e"))
    head = first.select(F.lit("").alias("place"), F.format_string("cases: %d recall: %s answers: %s errors: %d", "n", F.col("r").cast("string"), F.col("a").cast("string"), "e").alias("line"))
    failed = F.coalesce("error", F.lit("")) != ""
    line = F.when(failed, F.concat(F.lit("! "), "id", F.lit(": "), "error")).when(~F.col("retrieval_hit"), F.concat(F.lit("search "), "id")).when(~F.col("answer_ok"), F.concat(F.lit("answer "), "id"))
    rest = results.select(F.col("id").alias("place"), line.alias("line")).where("line IS NOT NULL")
    return head.unionByName(rest).orderBy("place")


def reset(spark: SparkSession, tables: dict[str, DataFrame], keep: Sequence[str] = ("issues", "contacts", "contours")) -> dict[str, DataFrame]:
    """Empty tables of the same columns in place of all but those kept."""
    return {name: t if name in keep else t.limit(0) for name, t in tables.items()}


def blocked_terms(domains: Sequence[str], names: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    """What no outside query may carry, longest first: domains and their names, people, and given terms."""
    bases = [d.split(".")[0] for d in domains]
    parts = [p.strip(" .,") for n in names for p in n.split()]
    return sorted({t for t in [*domains, *bases, *(b.replace("-", " ") for b in bases), *parts, *extra] if len(t) >= 3}, key=lambda t: (-len(t), t))


def sanitize_query(query: Column, blocked: Sequence[str] = ()) -> Column:
    """A query without addresses, phones, shares, inner hosts, private IPs and blocked terms; null if hardly anything is left."""
    q = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)\s+", " "))
    private = r"(?<![\d.])(?:10(?:\.\d{1,3}){3}|127(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|169\.254(?:\.\d{1,3}){2})(?![\d.])"
    cuts = [text.EMAIL, text.PHONE, r"\\\\[^\s]+", r"(?iu)(?<![\p{L}\p{N}_.-])[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.(?:lcl|local|lan|corp|internal)(?![\p{L}\p{N}_])", private]
    cuts += [rf"(?iu)(?<![\p{{L}}\p{{N}}_])\Q{t}\E(?![\p{{L}}\p{{N}}_])" for t in blocked]
    for pattern in cuts:
        q = F.regexp_replace(q, pattern, " ")
    q = F.left(F.regexp_replace(F.trim(F.regexp_replace(q, r"(?U)\s+", " ")), r"^[ ,;:.-]+|[ ,;:.-]+$", ""), F.lit(400))
    return text.bind(q, lambda x: F.when(F.length(F.regexp_replace(x, r"[^\p{L}\p{N}_]", "")) >= 4, x))


def public_host(host: Column, inner: Sequence[str] = ()) -> Column:
    """Whether a host may be read from outside by its name: dotted, not inner, no private address."""
    h = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.$", "")
    ok = F.contains(h, F.lit(".")) & ~F.regexp_like(h, F.lit(r"\.(lcl|local|lan|corp|internal)$"))
    ok = ok & ~F.regexp_like(h, F.lit(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|22[4-9]\.|2[3-5]\d\.)[\d.]*$"))
    for d in inner:
        ok = ok & (h != d) & ~F.endswith(h, F.lit("." + d))
    return ok
