"""Chunks: from parsed rows to texts with an identity, and into the index with vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkb.functions import chunking, entities, text
from loomkb.sources import code

EMBED_CHARS, EMBED_BATCH, SHRINK, HIT_CHARS, DIM = 6000, 64, 0.6, 1500, 64
CHUNK = ["chunk_id", "source", "title", "text", "doc_type", "objects", "attrs"]


def _flat(**values: Column) -> Column:
    """Map of the values that are there."""
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull() & (p["value"] != "")))


def _chunks(rows: DataFrame, attrs: Column) -> DataFrame:
    out = rows.withColumn("chunk_id", text.chunk_id(F.col("source"), F.col("title"), F.col("text"))).withColumn("attrs", attrs)
    return out.select(*CHUNK)


def _parts(rows: DataFrame, lines: str, limit: int = chunking.LIMIT) -> DataFrame:
    """A row for each packed group of ``lines``, as ``body`` and its number ``part`` from 0."""
    return rows.select("*", F.posexplode(chunking.packed(F.col(lines), limit)).alias("part", "body"))


def _numbered(title: Column) -> Column:
    return F.concat(title, F.when(F.col("part") > 0, F.concat(F.lit(" (часть "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.lit("")))


def head(title: Column, version: Column) -> Column:
    return F.concat(title, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit(" (ред. "), version, F.lit(")"))).otherwise(F.lit("")))


def section_chunks(sections: DataFrame) -> DataFrame:
    """Chunks of (source, doc_title, version, doc_type, section, title, paragraphs): paragraphs packed into groups, under document and section."""
    packed = _parts(sections.where("size(paragraphs) > 0"), "paragraphs").withColumn("title", _numbered(F.col("title")))
    full = F.concat(head(F.col("doc_title"), F.col("version")), F.lit("\n"), F.col("title"), F.lit("\n\n"), F.col("body"))
    rows = packed.withColumns({"text": full, "objects": entities.metadata_objects(F.col("body"))})
    return _chunks(rows, _flat(doc_title=F.left("doc_title", F.lit(200)), section=F.col("section"), doc_version=F.col("version")))


def case_text(num: Column, section: Column, function: Column, steps: Column) -> Column:
    """A test case as text: its section, function and numbered steps."""
    def step(s: Column, i: Column) -> Column:
        parts = [F.concat((i + 1).cast("string"), F.lit(". "), s["method"])]
        for name, label in (("criterion", "Критерий: "), ("result", "Результат: ")):
            parts.append(F.when(F.coalesce(s[name], F.lit("")) != "", F.concat(F.lit(label), s[name])))
        return F.concat_ws("\n", *parts)

    return F.concat_ws("\n", F.concat(F.lit("Тест-кейс № "), num, F.lit(" — "), function), F.nullif(section, F.lit("")), F.array_join(F.transform(steps, step), "\n"))


def case_chunks(cases: DataFrame) -> DataFrame:
    """A chunk for each test case (source, doc_title, version, num, section, function, steps, result)."""
    body = case_text(F.col("num"), F.col("section"), F.col("function"), F.col("steps"))
    rows = cases.withColumns({"text": F.concat_ws("\n", head(F.col("doc_title"), F.col("version")), body), "title": F.concat(F.lit("Тест-кейс № "), "num"), "doc_type": F.lit("pimi")})
    rows = rows.withColumn("objects", entities.metadata_objects(body))
    return _chunks(rows, _flat(doc_title=F.left("doc_title", F.lit(200)), test_case=F.col("num"), result=F.col("result")))


def plan_chunks(items: DataFrame) -> DataFrame:
    """A chunk for each plan item (source, doc_title, version, doc_type, num, group, object, procedures)."""
    named = F.concat(F.lit("Пункт плана тестирования № "), "num")
    body = F.concat_ws("\n", F.concat(named, F.lit(" — "), "object"), F.nullif("group", F.lit("")), F.array_join("procedures", "\n"))
    rows = items.withColumns({"text": F.concat_ws("\n", head(F.col("doc_title"), F.col("version")), body), "title": named, "objects": entities.metadata_objects(body)})
    return _chunks(rows, _flat(doc_title=F.left("doc_title", F.lit(200)), plan_item=F.col("num")))


def coverage_chunks(rows: DataFrame) -> DataFrame:
    """A chunk for each row of a coverage table (source, doc_title, version, doc_type, document, items, coverage)."""
    said = F.concat(F.lit("Документ "), "document", F.lit(" покрывает пункты плана тестирования: "), "items", F.lit("."))
    said = F.concat(said, F.when(F.coalesce("coverage", F.lit("")) != "", F.concat(F.lit(" Покрытие: "), "coverage", F.lit("."))).otherwise(F.lit("")))
    out = rows.withColumns({"text": F.concat_ws("\n", head(F.col("doc_title"), F.col("version")), said), "title": F.concat(F.lit("Покрытие: "), F.left("document", F.lit(80)))})
    return _chunks(out.withColumn("objects", F.array().cast("array<string>")), _flat(doc_title=F.left("doc_title", F.lit(200)), coverage_doc=F.left("document", F.lit(200))))


def comment_chunks(rows: DataFrame) -> DataFrame:
    """A chunk for each comment (source, doc_title, version, doc_type, author, date, anchor, body)."""
    at = F.when(F.coalesce("anchor", F.lit("")) != "", F.concat(F.lit(" к фрагменту «"), "anchor", F.lit("»"))).otherwise(F.lit(""))
    said = F.concat(F.lit("Комментарий "), "author", F.lit(" от "), "date", at, F.lit(":\n"), "body")
    out = rows.withColumns({"text": F.concat_ws("\n", head(F.col("doc_title"), F.col("version")), said), "title": F.concat(F.lit("Комментарий "), "author")})
    return _chunks(out.withColumn("objects", F.array().cast("array<string>")), _flat(doc_title=F.left("doc_title", F.lit(200)), comment_author=F.col("author")))


def removed_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of struck-out texts (source, doc_title, version, doc_type, lines), marked as removed."""
    packed = _parts(rows.where("size(lines) > 0"), "lines").withColumn("title", _numbered(F.lit("Удалённые формулировки")))
    listed = F.regexp_replace(F.concat(F.lit("– "), "body"), "\n", "\n– ")
    note = "Удалённые (зачёркнутые) формулировки — вычеркнутые, исключённые из документа проверки и требования:"
    out = packed.withColumns({"text": F.concat_ws("\n", head(F.col("doc_title"), F.col("version")), F.lit(note), listed), "objects": F.array().cast("array<string>")})
    return _chunks(out, _flat(doc_title=F.left("doc_title", F.lit(200)), revision=F.lit("removed")))


def table_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of generic tables (source, doc_title, version, doc_type, section, rows of group and values)."""
    def line(r: Column) -> Column:
        values = F.array_join(F.transform(F.map_entries(r["values"]), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
        return F.concat(F.when(F.coalesce(r["group"], F.lit("")) != "", F.concat(F.lit("["), r["group"], F.lit("] "))).otherwise(F.lit("")), values)

    packed = _parts(rows.withColumn("lines", F.transform("rows", line)).where("size(lines) > 0"), "lines")
    packed = packed.withColumn("title", _numbered(F.concat("section", F.lit(" — таблица"))))
    full = F.concat(head(F.col("doc_title"), F.col("version")), F.lit("\n"), F.col("title"), F.lit("\n\n"), F.col("body"))
    out = packed.withColumns({"text": full, "objects": entities.metadata_objects(F.col("body"))})
    return _chunks(out, _flat(doc_title=F.left("doc_title", F.lit(200))))


def message_chunks(letters: DataFrame) -> DataFrame:
    """A chunk for each letter (source, subject, sender, sender_email, to, cc, sent_at, attachments, body, thread, origin): masked header, then body."""
    domain = F.when(F.contains("sender_email", F.lit("@")), F.substring_index("sender_email", "@", -1))
    sender = F.concat("sender", F.coalesce(F.concat(F.lit(" ("), domain, F.lit(")")), F.lit("")))

    def named(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    header = F.concat_ws(
        "\n",
        F.concat(F.lit("Тема: "), F.coalesce("subject", F.lit(""))),
        F.concat(F.lit("От: "), F.coalesce(sender, F.lit(""))),
        named("Кому: ", text.people(F.col("to"))),
        named("Копия: ", text.people(F.col("cc"))),
        named("Дата: ", F.date_format("sent_at", "dd.MM.yyyy HH:mm")),
        named("Вложения: ", F.array_join("attachments", ", ")),
    )
    rows = letters.where("coalesce(body, '') <> ''").withColumns(
        {"text": F.concat(text.mask_pii(header), F.lit("\n\n"), "body"), "title": F.col("subject"), "doc_type": F.lit("email"), "objects": F.array().cast("array<string>")}
    )
    return _chunks(rows, _flat(thread_id=F.col("thread"), origin=F.col("origin")))


def method_chunks(methods: DataFrame, config: str) -> DataFrame:
    """A chunk for each method of source modules: header, signature, contexts, intercepts, then its text."""
    owner = code.module_owner(F.col("module"))
    place = F.concat(owner, F.lit(" · "), "module", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    signature = F.concat("kind", F.lit(" "), "name", F.lit("("), "params", F.lit(")"), F.when(F.col("export"), F.lit(" Экспорт")).otherwise(F.lit("")))
    marks = F.array_join(F.transform("intercepts", lambda i: F.concat(F.lit("&"), i["annotation"], F.lit('("'), i["target"], F.lit('")'))), ", ")
    header = F.concat_ws(
        "\n", place, signature, F.when(F.size("context") > 0, F.concat(F.lit("Контекст: "), F.array_join("context", ", "))),
        F.when(F.size("intercepts") > 0, F.concat(F.lit("Перехват: "), marks)),
    )
    custom = code.custom_object(F.substring_index(owner, ".", -1)) | code.custom_object(F.col("name"))
    rows = methods.withColumns(
        {
            "source": F.concat(F.lit(f"{config}/"), "module", F.lit("#L"), F.col("start_line").cast("string")),
            "title": F.concat(owner, F.lit("."), "name"),
            "doc_type": F.lit("bsl_method"),
            "objects": F.concat(F.array(owner), "md_refs"),
            "__text": F.concat(header, F.lit("\n\n"), "text"),
        }
    ).withColumn("text", F.col("__text"))
    flags = {"export": F.col("export"), "custom": custom, "intercept": F.size("intercepts") > 0}
    return _chunks(rows, _flat(module=F.col("module"), method=F.col("name"), doc_version=F.lit(config), **flags))


def card_text() -> Column:
    """Text card of a metadata object's row."""
    named = lambda a: F.concat(F.lit("Реквизит "), a["name"], F.when(F.coalesce(a["synonym"], F.lit("")) != "", F.concat(F.lit(" «"), a["synonym"], F.lit("»"))).otherwise(F.lit("")), F.when(F.size(a["types"]) > 0, F.concat(F.lit(": "), F.array_join(a["types"], ", "))).otherwise(F.lit("")))
    first = F.concat("kind", F.lit("."), "name", F.when(F.coalesce("synonym", F.lit("")) != "", F.concat(F.lit(" «"), "synonym", F.lit("»"))).otherwise(F.lit("")))
    return F.concat_ws(
        "\n",
        first,
        F.when(F.col("adopted"), F.lit("Заимствован в расширение")),
        F.when(code.custom_object(F.col("name")), F.lit("Доработка интегратора (КС)")),
        F.nullif(F.array_join(F.transform("attributes", named), "\n"), F.lit("")),
        F.nullif(F.array_join(F.transform("tabular_sections", lambda t: F.concat(F.lit("Табличная часть "), t["name"], F.lit(": "), F.array_join(t["columns"], ", "))), "\n"), F.lit("")),
    )


def card_chunks(objects: DataFrame, config: str) -> DataFrame:
    """A chunk for each metadata object."""
    full = F.concat("kind", F.lit("."), "name")
    rows = objects.withColumns(
        {"text": card_text(), "title": full, "doc_type": F.lit("md_object"), "objects": F.array(full), "source": F.concat(F.lit(f"{config}/"), F.substring_index("source", "/", -1))}
    )
    return _chunks(rows, _flat(doc_version=F.lit(config), custom=code.custom_object(F.col("name")), adopted=F.col("adopted")))


def config_chunks(methods: DataFrame, objects: DataFrame, config: str) -> DataFrame:
    """Chunks of a configuration: its methods and its metadata cards."""
    return method_chunks(methods, config).unionByName(card_chunks(objects, config))


Embed = Callable[[Sequence[str], bool], list[list[float]]]


def hashed_vectors(texts: Sequence[str], is_query: bool = False) -> list[list[float]]:
    """Deterministic unit vectors from hashed word beginnings: close texts have close vectors. For tests and offline use."""
    import hashlib

    import numpy as np

    out = []
    for t in texts:
        v = np.zeros(DIM)
        v[0] = 0.01
        for word in (t or "").lower().split():
            v[int(hashlib.md5(word[:6].encode()).hexdigest(), 16) % DIM] += 1.0
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def embedded(column: Column, embed: Embed = hashed_vectors, is_query: bool = False, limit: int = EMBED_CHARS) -> Column:
    """Vectors of a text column by the function given, an Arrow batch at a time.

    ``EMBED_BATCH`` texts are sent at a time, up to ``limit`` characters of each,
    as the service takes them. Of a batch that it refuses each text is sent by
    itself, and one that is too long again with 0.6 of its characters.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str) -> list[float] | None:
            size = limit
            while size >= 1:
                try:
                    return embed([t[:size]], is_query)[0]
                except ValueError:
                    size = int(size * SHRINK)
            return None

        def several(texts: list[str]) -> list[list[float] | None]:
            try:
                found = embed([t[:limit] for t in texts], is_query)
                return list(found) if len(found) == len(texts) else [one(t) for t in texts]
            except ValueError:
                return [one(t) for t in texts]

        for batch in batches:
            texts = [t or "" for t in batch]
            parts = [several(texts[i : i + EMBED_BATCH]) for i in range(0, len(texts), EMBED_BATCH)]
            yield pd.Series([v for part in parts for v in part], dtype=object)

    return vectors(column)


def vector_literal(vector: Column) -> Column:
    """A vector with six significant digits and no trailing zeros, as the index reads it."""

    def digits(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x.cast("double")), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")

    return F.concat(F.lit("["), F.array_join(F.transform(vector, digits), ","), F.lit("]"))


def upsert_chunks(index: DataFrame, incoming: DataFrame, embed: Embed = hashed_vectors) -> DataFrame:
    """Rows to append to ``index``: chunks whose id it has not, each once, with their vectors; known ones are not embedded again."""
    fresh = incoming.dropDuplicates(["chunk_id"]).join(index.select("chunk_id"), "chunk_id", "left_anti")
    return fresh.withColumn("embedding", embedded(F.col("text"), embed)).withColumn("status", F.lit("current"))


def format_hits(hits: DataFrame, limit: int = HIT_CHARS) -> DataFrame:
    """Hits as shown: their source label and the beginning of their text."""
    return hits.withColumns({"label": entities.source_label(F.col("attrs"), F.col("text")), "text": F.left("text", F.lit(limit))})


def dump(chunks: DataFrame, preview: int | None = None) -> DataFrame:
    """One column ``value``: a JSON line for each chunk, or its title and the first characters of its text."""
    if preview is None:
        return chunks.select(F.to_json(F.struct(F.col("chunk_id").alias("id"), F.col("attrs").alias("attributes"), "text")).alias("value"))
    return chunks.select(F.concat("title", F.lit("\n"), F.left("text", F.lit(preview))).alias("value"))


def corpus_letters(letters: DataFrame) -> DataFrame:
    """Letters once over all files: (letter, canonical), where any shared key joins letters and those from files come before quotes.

    ``letters`` has letter, origin and keys. Keys meet by shuffle, each as a
    star around its first letter, so a key that many letters share adds rows in
    proportion to them.
    """
    from loomkb.operators.components import connected_components
    from loomkb.storage import materialize

    keyed = materialize(letters.select("letter", F.explode("keys").alias("k")), "letter-keys")
    first = keyed.groupBy("k").agg(F.min("letter").alias("first"))
    groups = connected_components(keyed.join(first, "k").select(F.col("letter").alias("a"), F.col("first").alias("b")))
    named = letters.join(groups, letters["letter"] == groups["node"], "left").withColumn("group", F.coalesce("component", "letter"))
    best = named.groupBy("group").agg(F.min_by("letter", F.struct(F.col("origin") != "file", "letter")).alias("canonical"))
    return named.join(best, "group").select("letter", "canonical")


def corpus_report(documents: DataFrame, sections: DataFrame, cases: DataFrame) -> DataFrame:
    """(doc_id, sections, cases) of each document, and of all in a row with null."""
    counts = documents.select("doc_id").join(sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("s")), "doc_id", "left")
    counts = counts.join(cases.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")), "doc_id", "left")
    return counts.rollup("doc_id").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("sections"), F.coalesce(F.sum("c"), F.lit(0)).alias("cases"))
