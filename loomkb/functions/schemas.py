"""JSON schemas as column expressions: what is wrong with a value, and where."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomkb.storage import materialize

# Names of a value's kinds in schemas and in the engine.
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "integer": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}
KNOWN = frozenset("type properties required additionalProperties items enum minimum maximum minLength maxLength minItems maxItems description title $schema".split())


def _none() -> Column:
    return F.array().cast("array<string>")


def _when(wrong: Column, at: Column, text: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.concat(at, F.lit(f": {text}")))).otherwise(_none())


def violations(value: Column, schema: dict[str, Any], at: Column | None = None) -> Column:
    """Array of ``place: what is wrong`` of a variant; empty where it fits, and for a value that is not there.

    Knows types, properties, required, additionalProperties (true or false),
    items, enum of plain values, bounds of numbers, lengths of texts and
    arrays; a schema with anything else is an error. A whole number is an
    integer however it is written.
    """
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"unknown keywords: {', '.join(sorted(unknown))}")
    at = F.lit("$") if at is None else at
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    get = lambda path, type_: F.try_variant_get(value, path, type_)
    number, words, rows = get("$", "double"), F.when(kind == "STRING", get("$", "string")), F.when(kind == "ARRAY", get("$", "array<variant>"))
    numeric = kind.isin(*KINDS["number"])
    found: list[Column] = []
    if "type" in schema:
        named = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = F.lit(False)
        for name in named:
            whole = number == F.floor(number) if name == "integer" else F.lit(True)
            fits = fits | (kind.isin(*KINDS[name]) & whole)
        found.append(_when(~fits, at, f"no {' or '.join(named)}"))
    if "enum" in schema:
        equal = F.lit(False)
        for option in schema["enum"]:
            if option is None:
                same = kind == "VOID"
            elif isinstance(option, bool):
                same = (kind == "BOOLEAN") & (get("$", "boolean") == F.lit(option))
            elif isinstance(option, str):
                same = words == F.lit(option)
            else:
                same = numeric & (number == F.lit(float(option)))
            equal = equal | F.coalesce(same, F.lit(False))
        found.append(_when(~equal, at, "none of the values"))
    bounds = (("minimum", numeric & (number < F.lit(float(schema.get("minimum", 0)))), "too small"), ("maximum", numeric & (number > F.lit(float(schema.get("maximum", 0)))), "too large"))
    sizes = [("minLength", F.length(words), True), ("maxLength", F.length(words), False), ("minItems", F.size(rows), True), ("maxItems", F.size(rows), False)]
    found += [_when(wrong, at, text) for word, wrong, text in bounds if word in schema]
    for word, size, least in sizes:
        if word in schema:
            there = words.isNotNull() if word.endswith("Length") else rows.isNotNull()
            wrong = size < schema[word] if least else size > schema[word]
            found.append(_when(there & wrong, at, "too short" if least else "too long"))
    fields = F.when(kind == "OBJECT", get("$", "map<string,variant>"))
    keys = F.map_keys(fields)
    for name in schema.get("required", ()):
        found.append(_when(~F.array_contains(keys, F.lit(name)), at, f"{name} is missing"))
    if schema.get("additionalProperties") is False:
        more = F.filter(keys, lambda k: ~k.isin(*schema.get("properties", {})) if schema.get("properties") else F.lit(True))
        found.append(F.coalesce(F.transform(F.array_sort(more), lambda k: F.concat(at, F.lit(": "), k, F.lit(" is not known"))), _none()))
    for name, inner in schema.get("properties", {}).items():
        child = F.try_element_at(fields, F.lit(name))
        found.append(F.when(child.isNotNull(), violations(child, inner, F.concat(at, F.lit(f".{name}")))).otherwise(_none()))
    if "items" in schema:
        each = F.transform(rows, lambda v, i: violations(v, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), _none()))
    return F.when(value.isNotNull(), F.concat(*found) if found else _none()).otherwise(_none())


def checked(answer: Column, schema: dict[str, Any]) -> Column:
    """Struct (value, errors) of a text that should be JSON of the schema; null texts and no JSON have no value."""
    value = F.try_parse_json(answer)
    errors = F.when(value.isNull(), F.array(F.lit("$: no JSON"))).otherwise(violations(value, schema))
    return F.struct(value.alias("value"), errors.alias("errors"))


def structured_answers(rows: DataFrame, prompt: str, call: Callable[[list[str]], list[str | None]], schema: dict[str, Any], tries: int = 2) -> DataFrame:
    """``rows`` with answer, errors and asked: what ``call`` says to each prompt, asked again with the errors up to ``tries`` times.

    ``call`` runs in tasks on batches of prompts; it is the caller's. Answers
    are written down after each round, so no prompt is paid for twice when an
    executor is lost later.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["__answer"] = pd.Series(call(batch["__prompt"].tolist()), index=batch.index, dtype=object)
            yield batch

    kept = [c for c in rows.columns if c not in ("answer", "errors", "asked")]
    todo = rows.select(*kept, F.col(prompt).alias("__prompt"))
    done = None
    for attempt in range(1, tries + 1):
        answered = todo.mapInPandas(ask, StructType([*todo.schema.fields, StructField("__answer", StringType())]))
        judged = answered.withColumn("__errors", checked(F.col("__answer"), schema)["errors"]).withColumn("__asked", F.lit(attempt))
        judged = materialize(judged, "answers")
        over = judged if attempt == tries else judged.where("size(__errors) = 0")
        done = over if done is None else done.unionByName(over)
        again = F.concat(F.col(prompt), F.lit("\n\nErrors of the last answer:\n"), F.array_join("__errors", "\n"))
        todo = judged.where("size(__errors) > 0").select(*kept, again.alias("__prompt"))
    return done.select(*kept, F.col("__answer").alias("answer"), F.col("__errors").alias("errors"), F.col("__asked").alias("asked"))
