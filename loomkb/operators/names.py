"""Names in texts: inflected forms, every occurrence by an automaton, places as said.

Forms of names are grouped into shards of bounded size. A shard's forms make one
Aho-Corasick automaton, which each worker builds once and runs over Arrow
batches of whole texts; more names than one shard holds are more passes over
the texts, and never more memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkb.storage import materialize

# Endings of names, and those that take their place in other cases.
ENDINGS = {"а": "е у ы ой и", "я": "и ю е ей", "ь": "и е ью я ем"}
AFTER_CONSONANT, VOWELS = "е а у ом", "аеёиоуыэюя"
#: Bytes of forms in one automaton: with the automaton's nodes, some 50 times that in a worker. Rows taken from Arrow at a time.
SHARD_BYTES, ROWS = 1 << 20, 256
OCCURRENCES = "id long, name_id long, start long, said string"


def folded(name: Column) -> Column:
    """A name as it is compared: lower case, е for ё, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), "ё", "е"), r"\s+", " "))


def inflected(name: Column) -> Column:
    """Array of the forms of a name, itself first; a name of several words has no other."""
    low = folded(name)
    stem = F.substring(low, F.lit(1), F.length(low) - 1)
    attached = lambda base, endings: F.transform(F.array(*[F.lit(e) for e in endings.split()]), lambda e: F.concat(base, e))
    others = F.when(F.contains(low, F.lit(" ")), F.array().cast("array<string>"))
    for last, endings in ENDINGS.items():
        others = others.when(F.endswith(low, F.lit(last)), attached(stem, endings))
    others = others.when(F.regexp_like(low, F.lit(f"[{VOWELS}]$|[^\\p{{L}}]$")), F.array().cast("array<string>")).otherwise(attached(low, AFTER_CONSONANT))
    return F.when(F.coalesce(low, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(low), others)))


def _fold(text: str) -> str:
    """``folded`` without changing places: one character for each."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("ё", "е")


_automata: dict[str, object] = {}


def _automaton(key: str, forms: list[tuple[str, list[int]]]):
    """The worker's automaton of a shard: built by its first task, one kept at a time."""
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        automaton = ahocorasick.Automaton()
        for form, ids in forms:
            automaton.add_word(form, (len(form), ids))
        automaton.make_automaton()
        _automata[key] = automaton
    return _automata[key]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def occurrences(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", inflect: bool = True) -> DataFrame:
    """(id, name_id, start, said): every occurrence of names (name_id, name) as whole words in whole texts.

    Case and ё do not matter; ``start`` counts characters from 0. Occurrences
    may overlap; a form of several names is an occurrence of each. Null and
    empty texts and names have none; repeated rows have theirs each; a name
    given twice counts once.
    """
    forms = names.select(F.col("name_id").cast("long").alias("name_id"), F.explode(inflected(F.col("name")) if inflect else F.array(folded(F.col("name")))).alias("form"))
    forms = forms.where("form <> '' AND name_id IS NOT NULL").groupBy("form").agg(F.collect_set("name_id").alias("ids"))
    size = F.sum(F.octet_length("form") + 8 * F.size("ids"))
    forms = materialize(forms, "forms")
    shards = -(-(forms.agg(size).first()[0] or 0) // SHARD_BYTES)
    dealt = materialize(forms.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(max(1, shards)))), "shards")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    found = texts.where("false").select("id", F.lit(None).cast("long").alias("name_id"), F.lit(None).cast("long").alias("start"), F.col("text").alias("said"))
    for shard in range(shards):
        held = [(r["form"], r["ids"]) for r in dealt.where(F.col("shard") == shard).collect()]  # of bounded size
        found = found.unionByName(texts.mapInArrow(_finder(uuid.uuid4().hex, held), OCCURRENCES))
    return found


def _finder(key: str, forms: list[tuple[str, list[int]]]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, forms)
        schema = pa.schema([("id", pa.int64()), ("name_id", pa.int64()), ("start", pa.int64()), ("said", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                out: tuple[list, ...] = ([], [], [], [])
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    low = _fold(text)
                    for end, (length, ids) in automaton.iter(low):
                        start = end + 1 - length
                        if (start and _word(low[start - 1]) and _word(low[start])) or (end + 1 < len(low) and _word(low[end + 1]) and _word(low[end])):
                            continue
                        for name in ids:
                            for column, value in zip(out, (doc_id, name, start, text[start : end + 1])):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return find


def named_contours(docs: DataFrame, contours: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, contour, times): contours (id, name, aliases) that texts name by name or alias in any form."""
    every = contours.select(F.col("id").alias("name_id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    found = occurrences(docs, every.where("name IS NOT NULL"), id_col, text_col)
    # a name and an alias may share a form at one place
    return found.groupBy("id", F.col("name_id").alias("contour")).agg(F.count_distinct("start", "said").alias("times"))


def resolve_places(said: DataFrame, places: DataFrame, learned: DataFrame, none: DataFrame) -> DataFrame:
    """``said`` (said, ...) with city, country, zone, source: places (city, country, zone) in any form, then what was learned (said, city, country, zone).

    Words of ``none`` (word), alone or at the beginning, are no places. Of
    several places of one form the first city by name counts. Unknown ones
    have no city and the source "unknown", or "no place".
    """
    forms = places.select(F.explode(inflected(F.col("city"))).alias("__key"), F.struct("city", "country", "zone").alias("p"))
    forms = forms.groupBy("__key").agg(F.min("p").alias("__known"))
    cached = learned.groupBy(folded(F.col("said")).alias("__key")).agg(F.min(F.struct("city", "country", "zone")).alias("__learned"))
    words = none.select(folded(F.col("word")).alias("__none")).distinct()
    keyed = said.withColumn("__key", folded(F.regexp_replace("said", r"^[\s«»\"'.,;:!?]+|[\s«»\"'.,;:!?]+$", "")))
    whole, head = words.withColumnRenamed("__none", "__whole"), words.withColumnRenamed("__none", "__head")
    marked = keyed.join(whole, F.col("__key") == F.col("__whole"), "left").join(head, F.substring_index("__key", " ", 1) == F.col("__head"), "left")
    out = marked.join(forms, "__key", "left").join(cached, "__key", "left")
    nowhere = F.col("__whole").isNotNull() | F.col("__head").isNotNull()
    place = F.when(~nowhere, F.coalesce("__known", "__learned"))
    source = F.when(nowhere, "no place").when(F.col("__known").isNotNull(), "directory").when(F.col("__learned").isNotNull(), "learned").otherwise("unknown")
    return out.select(*[said[c] for c in said.columns], *[place[c].alias(c) for c in ("city", "country", "zone")], source.alias("source"))
