"""What comes in: results and attachments as text, signatures, name resolution, journals and caches."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkb.functions import text
from loomkb.operators import joins, registry

# How much of files and results is taken.
FILE_CHARS, ALL_CHARS, FILES, SNIPPET = 12_000, 30_000, 10, 600


def search_results(pages: DataFrame, column: str = "xml", k: int = 10) -> DataFrame:
    """(place, title, url, domain, snippet) of the first ``k`` documents in search answers; an answer with an error has none.

    Each document is a row with its own fields: its address stands for a title
    that is missing, the address's host for a domain, and the headline for
    passages. Documents without an address are left out and have no place. Answers
    are read by their marks, so broken ones give what they have.
    """

    def inside(text: Column, tag: str) -> Column:
        """What stands in each element ``tag``; elements of one kind do not nest here."""
        return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?=[\s>])(?:[^>]*[^/])?>(.*?)</{tag}>"), F.lit(1))

    def plain(markup: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(markup, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]*>", "")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))

    def fields(doc: Column) -> Column:
        one = lambda tag: F.nullif(plain(F.get(inside(doc, tag), F.lit(0))), F.lit(""))
        said = F.filter(F.transform(inside(doc, "passage"), plain), lambda p: p != "")
        snippet = F.when(F.size(said) > 0, F.array_join(said, " … ")).otherwise(F.coalesce(one("headline"), F.lit("")))
        host = F.regexp_extract(one("url"), r"^[^:/?#]+://([^/?#]*)", 1)
        named = {"title": F.coalesce(one("title"), one("url")), "url": one("url"), "domain": F.coalesce(one("domain"), host), "snippet": F.left(snippet, F.lit(SNIPPET))}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    found = pages.where(~F.regexp_like(column, F.lit(r"(?s)<response\b.*?<error\b")))
    placed = F.slice(F.filter(F.transform(inside(F.col(column), "doc"), fields), lambda r: r["url"].isNotNull()), 1, k)
    kept = [c for c in pages.columns if c != column]
    return found.select(*kept, F.posexplode(placed).alias("place", "r")).select(*kept, "place", "r.*")


def attachment_texts(files: DataFrame, group: str = "message") -> DataFrame:
    """``files`` (message, position, sha256, text) with ``shown``: ten files, each content once, each cut, and all of a message within their budget."""
    first = registry.first_of(files, [group, "sha256"], [F.col("position")])
    rank = F.row_number().over(Window.partitionBy(group).orderBy("position"))
    few = first.withColumn("__r", rank).where(F.col("__r") <= FILES).drop("__r").withColumn("text", F.left("text", F.lit(FILE_CHARS)))
    return registry.running_budget(few, group, [F.col("position")], "text", ALL_CHARS)


def resolved_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations (chunk, source, target, kind) between names that are entities of the same chunk, with their keys."""
    named = entities.select("chunk", F.lower("name").alias("__n"), "key")
    a, b = named.toDF("chunk", "__a", "source_key"), named.toDF("chunk", "__b", "target_key")
    both = relations.withColumns({"__a": F.lower("source"), "__b": F.lower("target")}).join(a, ["chunk", "__a"]).join(b, ["chunk", "__b"])
    return both.select("chunk", "source_key", "kind", "target_key").distinct()


def signature(body: Column, name: Column) -> Column:
    """Struct (position, phone, organization) of a letter's last lines: a phone, a company form, else the first line that is neither name nor address."""
    clean = text.normalize_whitespace(text.unwrap_safelinks(text.dedent_quoted(F.coalesce(body, F.lit("")))))
    phone_at = r"(?iu)(?:\+\d{1,3}|8)[\s(-]*\d{2,4}[\s)-]*\d{2,4}(?:[\s-]*\d{2,4}){1,3}"
    company = r"(?iu)(?<![\p{L}])(?:ООО|АО|ПАО|ЗАО|ИП|LLC|Ltd|GmbH|Inc|S\.?A\.?S?)(?![\p{L}])"

    def fields(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(text.SIGNATURE))
        tail = F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(F.lit(""))
        lines = F.filter(F.transform(F.slice(F.split(tail, "\n"), 2, 10), lambda x: F.trim(F.regexp_replace(x, r"^[\s,;|]+|[\s,;|]+$", ""))), lambda x: x != "")
        parts = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda p: F.length(p) > 2)

        def plain(x: Column) -> Column:
            named = F.exists(parts, lambda p: F.contains(F.lower(x), p))
            return ~named & ~F.regexp_like(x, F.lit(r"@|\d|https?:")) & ~F.regexp_like(x, F.lit(company)) & (F.length(x) <= 90)

        return F.struct(
            F.get(F.filter(lines, plain), F.lit(0)).alias("position"),
            F.nullif(F.regexp_extract(F.array_join(lines, "\n"), phone_at, 0), F.lit("")).alias("phone"),
            F.get(F.filter(lines, lambda x: F.regexp_like(x, F.lit(company))), F.lit(0)).alias("organization"),
        )

    return text.bind(clean, fields)


def toc_lines(block: Column) -> Column:
    """Entries (title, page) of a table of contents said line by line: a title, dots or spaces, a page."""
    line = r"^\s*(.{2,200}?)[\s.…·—–-]+(\d{1,5})\s*$"
    found = F.filter(F.split(block, r"\r?\n"), lambda x: F.regexp_like(x, F.lit(line)))
    return F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, line, 1)).alias("title"), F.regexp_extract(x, line, 2).cast("int").alias("page")))


def chain_rows(letters: DataFrame) -> DataFrame:
    """Own text and quoted letters (source, body) of split letters as rows of a chain: the quote at place n is ``source#quoteN``."""
    own = F.struct(F.col("sender"), F.col("sent_at").alias("date"), F.col("subject"), F.col("t.own").alias("text"))
    quoted = F.transform("t.quoted", lambda q: F.struct(q["sender"].alias("sender"), q["date"].alias("date"), q["subject"].alias("subject"), q["text"].alias("text")))
    rows = letters.select("source", F.posexplode(F.concat(F.array(own), quoted)).alias("position", "l"))
    name = F.when(F.col("position") == 0, F.col("source")).otherwise(F.concat("source", F.lit("#quote"), F.col("position").cast("string")))
    return rows.select("source", "position", name.alias("part"), F.when(F.col("position") == 0, F.lit("file")).otherwise(F.lit("quoted")).alias("origin"), "l.*")


def file_block(items: DataFrame) -> DataFrame:
    """One ``line`` for each file of an intake (position, filename, kind, about, relation, action)."""
    parts = F.concat_ws("; ", "kind", F.nullif("about", F.lit("")), "relation", F.concat(F.lit("→ "), "action"))
    return items.select("position", F.concat(F.col("position").cast("string"), F.lit(". "), "filename", F.lit(" — "), parts).alias("line"))


def journal(records: DataFrame, path: str, now: Column | None = None) -> None:
    """Append records as JSON lines with the time they were written."""
    records.withColumn("at", now if now is not None else F.current_timestamp()).write.mode("append").json(path)


def cached(asked: DataFrame, answers: DataFrame, keys: Sequence[str], seconds: int = 600) -> tuple[DataFrame, DataFrame]:
    """(rows with an answer that is fresh enough, rows to ask again) for requests with a time ``at``."""
    joined = joins.as_of_join(asked, answers, list(keys), "at", "answered_at", ["answer", "answered_at"], slices=F.to_date)
    fresh = F.coalesce(F.unix_timestamp("at") - F.unix_timestamp("answered_at") <= seconds, F.lit(False))
    return joined.where(fresh), joined.where(~fresh).select(*asked.columns)


def in_project(rows: DataFrame, project: str) -> DataFrame:
    """Rows of one project; a table partitioned by it reads no other."""
    return rows.where(F.col("project") == project)


def any_word_query(terms: DataFrame, group: str = "query") -> DataFrame:
    """(query, words): the distinct words of each query, any of which may hit, joined as the index writes them."""
    return terms.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("word")), " | ").alias("words"))


def seed(spark: SparkSession, known: DataFrame, catalogue: Sequence[tuple], keys: Sequence[str]) -> DataFrame:
    """Rows of a fixed catalogue that a table does not have yet; seeding twice adds nothing."""
    return registry.append_new(known, spark.createDataFrame(list(catalogue), known.schema), keys)


def package(prompt: str, materials: DataFrame, names: Sequence[str] = (), most: int = 50 << 20) -> bytes:
    """A zip of the prompt, the materials (name, text) without personal data, and a manifest; raises ValueError beyond ``most`` bytes.

    A package is what a person reads: its files come to the driver one by one,
    and the first that does not fit ends it.
    """
    from loomkb.operators.issues import scrub

    out, listed, held = io.BytesIO(), [], len(prompt.encode())
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("PROMPT.md", prompt)
        for r in materials.select("name", scrub(F.col("text"), names).alias("text")).orderBy("name").toLocalIterator():
            held += len(r["text"].encode())
            if held > most:
                raise ValueError(f"more than {most} bytes")
            z.writestr(f"materials/{r['name']}.md", r["text"])
            listed.append({"name": r["name"], "chars": len(r["text"])})
        z.writestr("MANIFEST.json", json.dumps({"materials": listed}, ensure_ascii=False))
    return out.getvalue()
