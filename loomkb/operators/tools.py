"""Operators for callers outside: SQL functions, and a table of named tools with schemas and handlers."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from loomkb.functions import assistant, threads
from loomkb.operators import sqltool


def register_functions(spark: SparkSession) -> list[str]:
    """Register the library's functions for SQL: scalar, aggregate and table functions. Returns their names."""

    @pandas_udf("int")
    def duration_minutes(said: pd.Series) -> pd.Series:
        return pd.Series([assistant.parse_duration(t) for t in said], dtype="Int32")

    @pandas_udf("timestamp")
    def letter_date(said: pd.Series) -> pd.Series:
        return pd.Series([threads.parse_date(t) for t in said])

    @pandas_udf("double")
    def middle(values: pd.Series) -> float:
        return float(values.median())

    @udtf(returnType="position: int, sender: string, sent_at: timestamp, subject: string, text: string")
    class quoted_letters:
        def eval(self, body: str):
            own, quoted = threads.split_thread(body)
            yield 0, None, None, None, own
            for i, q in enumerate(quoted, 1):
                yield i, q["sender"], q["date"], q["subject"], q["text"]

    spark.udf.register("duration_minutes", duration_minutes)
    spark.udf.register("letter_date", letter_date)
    spark.udf.register("middle", middle)
    spark.udtf.register("quoted_letters", quoted_letters)
    return ["duration_minutes", "letter_date", "middle", "quoted_letters"]


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    parameters: dict
    handler: Callable[..., object]
    #: What must be there for the tool to be offered.
    needs: tuple[str, ...] = ()

    def schema(self) -> dict:
        return {"type": "function", "name": self.name, "description": self.about, "parameters": strict_schema(self.parameters)}


def strict_schema(schema: dict) -> dict:
    """A JSON schema where every property is required, those that were optional may be null, and nothing else is allowed."""
    out = dict(schema)
    if out.get("type") == "object":
        required = set(out.get("required", ()))
        out["properties"] = {k: strict_schema(v) if k in required else nullable(strict_schema(v)) for k, v in out.get("properties", {}).items()}
        out["required"], out["additionalProperties"] = list(out["properties"]), False
    elif out.get("type") == "array":
        out["items"] = strict_schema(out.get("items", {}))
    return out


def nullable(schema: dict) -> dict:
    kind = schema.get("type")
    return schema if kind is None or isinstance(kind, list) else {**schema, "type": [kind, "null"]}


Search = Callable[[str, dict, int], DataFrame]


def tool_table(spark: SparkSession, sf_dir: str, search: Search | None = None, modules: DataFrame | None = None) -> list[Tool]:
    """The tools over the tables: plain SQL, document search, code search, module text and graph edges."""

    def rows(df: DataFrame, limit: int = 100) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.limit(limit).collect()]

    def sql(query: str) -> list[dict]:
        return rows(sqltool.run_query(spark, sf_dir, query))

    def search_documents(query: str, filters: dict | None = None, k: int = 8) -> list[dict]:
        return rows(search(query, filters or {}, k), k)

    def search_code(query: str, config: str | None = None, custom_only: bool | None = None, k: int = 8) -> list[dict]:
        wanted = {"doc_type": "bsl_method"} | ({"doc_version": config} if config else {}) | ({"custom": "true"} if custom_only else {})
        return rows(search(query, wanted, k), k)

    def get_module(module: str) -> list[dict]:
        return rows(modules.where(F.col("module") == module), 1)

    text, whole = {"type": "string"}, {"type": "integer"}
    return [
        Tool("sql", "A read-only query over the tables", {"type": "object", "properties": {"query": text}, "required": ["query"]}, sql),
        Tool("search_documents", "Chunks that answer a question", {"type": "object", "properties": {"query": text, "filters": {"type": "object", "properties": {}}, "k": whole}, "required": ["query"]}, search_documents, ("search",)),
        Tool("search_code", "Methods of the configuration", {"type": "object", "properties": {"query": text, "config": text, "custom_only": {"type": "boolean"}, "k": whole}, "required": ["query"]}, search_code, ("search",)),
        Tool("get_module", "Text of a source module", {"type": "object", "properties": {"module": text}, "required": ["module"]}, get_module, ("modules",)),
    ]


def available(tools: list[Tool], **services: object) -> list[dict]:
    """Schemas of the tools whose services are there."""
    return [t.schema() for t in tools if all(services.get(n) is not None for n in t.needs)]


def call(tools: list[Tool], name: str, arguments: str) -> str:
    """Result of a call as JSON; an unknown tool or a failing handler gives its error as JSON too."""
    tool = next((t for t in tools if t.name == name), None)
    if tool is None:
        return json.dumps({"error": f"no tool {name}"}, ensure_ascii=False)
    try:
        return json.dumps(tool.handler(**json.loads(arguments or "{}")), ensure_ascii=False, default=str)
    except Exception as e:  # the caller reads the reason
        return json.dumps({"error": f"{type(e).__name__}: {str(e)[:300]}"}, ensure_ascii=False)


def run_agent(question: str, tools: list[Tool], model: Callable[[list[dict], list[dict]], dict], steps: int = 6, **services: object) -> dict:
    """At most ``steps`` rounds of a model that answers {"answer": ...} or {"tool": ..., "arguments": ...}; a call made before is not made again."""
    messages, trace, seen = [{"role": "user", "content": question}], [], {}
    for step in range(steps + 1):
        offered = available(tools, **services) if step < steps else []
        said = model(messages, offered)
        if "tool" not in said or not offered:
            return {"answer": said.get("answer", ""), "steps": step, "trace": trace}
        key = (said["tool"], said.get("arguments", "{}"))
        repeat = key in seen
        seen[key] = seen[key] if repeat else call(tools, *key)
        trace.append({"tool": key[0], "arguments": key[1], "repeat": repeat})
        messages.append({"role": "tool", "name": key[0], "content": seen[key]})
    return {"answer": "", "steps": steps, "trace": trace}
