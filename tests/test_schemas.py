"""Schema columns against a validator of plain values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomkb.functions import schemas

SCHEMA = {
    "type": "object",
    "required": ["name", "items"],
    "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "minLength": 2, "maxLength": 5},
        "kind": {"enum": ["a", 1, None, True]},
        "score": {"type": ["number", "null"], "minimum": 0, "maximum": 10},
        "items": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["id"]}},
    },
}


def plain(value, schema, at="$"):
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    number = isinstance(value, (int, float)) and not isinstance(value, bool)

    def fits(name):
        if name in ("number", "integer"):
            return number and (name == "number" or value == int(value))
        return isinstance(value, kinds[name])

    out = []
    if "type" in schema:
        named = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if not any(map(fits, named)):
            out.append(f"{at}: no {' or '.join(named)}")
    if "enum" in schema and not any(value == o and isinstance(value, bool) == isinstance(o, bool) for o in schema["enum"]):
        out.append(f"{at}: none of the values")
    if number and value < schema.get("minimum", value):
        out.append(f"{at}: too small")
    if number and value > schema.get("maximum", value):
        out.append(f"{at}: too large")
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            out += [f"{at}: too short"] * (len(value) < schema.get(least, 0)) + [f"{at}: too long"] * (len(value) > schema.get(most, 1 << 30))
    if isinstance(value, dict):
        out += [f"{at}: {k} is missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}: {k} is not known" for k in sorted(value) if k not in schema.get("properties", {})]
        for k, inner in schema.get("properties", {}).items():
            if k in value:
                out += plain(value[k], inner, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += plain(v, schema["items"], f"{at}[{i}]")
    return out


def generated(rng, depth=0):
    pick = rng.randrange(9 if depth < 3 else 6)
    if pick < 6:
        return rng.choice([None, True, False, 1, -3, 2.5, 2.0, 11, "a", "abc", "too long text", ""])
    if pick == 6:
        return [generated(rng, depth + 1) for _ in range(rng.randrange(5))]
    keys = ["name", "kind", "score", "items", "id", "tags", "other"]
    return {k: generated(rng, depth + 1) for k in rng.sample(keys, rng.randrange(5))}


def test_columns_agree_with_plain_validation(spark):
    rng = random.Random(4)
    values = [{"name": "abc", "items": [{"id": 1}]}, {"name": "abc", "items": [{"id": 1.5, "tags": ["x", 2]}, {}, 3, {"id": 2}], "kind": True}]
    for _ in range(30):
        values.append({"name": rng.choice(["ab", "abcde"]), "kind": rng.choice(["a", 1, None, True]), "score": rng.choice([None, 0, 9.5]), "items": [{"id": rng.choice([1, 2.0]), "tags": ["x"]}] * rng.randrange(1, 4)})
    for _ in range(400):
        value = generated(rng)
        if isinstance(value, dict) and rng.random() < 0.7:
            value = {"name": "abc", "items": [{"id": 1, "tags": generated(rng, 1)}], **value}
        values.append(value)
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, "{cut"), (-2, None), (-3, "")], "i long, t string")
    got = {r["i"]: r["e"] for r in df.select("i", schemas.checked(F.col("t"), SCHEMA)["errors"].alias("e")).collect()}
    assert got[-1] == got[-2] == got[-3] == ["$: no JSON"]
    for i, value in enumerate(values):
        assert sorted(got[i]) == sorted(plain(value, SCHEMA)), value
    assert sum(not got[i] for i in range(len(values))) > 30


def test_unknown_keywords_are_errors():
    with pytest.raises(ValueError, match="oneOf"):
        schemas.violations(F.lit(None).cast("variant"), {"oneOf": []})


def test_answers_are_asked_again_with_their_errors(spark):
    def model(prompts):
        good = '{"name": "abc", "items": [{"id": 1}]}'
        return [good if "name is missing" in p or p == "easy" else None if p == "silent" else '{"items": [{"id": 1}]}' for p in prompts]

    rows = spark.createDataFrame([(1, "easy"), (2, "hard"), (3, "silent")], "i long, p string")
    got = schemas.structured_answers(rows, "p", model, SCHEMA, tries=2)
    assert sorted((r["i"], r["asked"], len(r["errors"])) for r in got.collect()) == [(1, 1, 0), (2, 2, 0), (3, 2, 1)]
    assert schemas.structured_answers(rows.limit(0), "p", model, SCHEMA).count() == 0
