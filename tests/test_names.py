"""Occurrences of names against brute force; forms; places."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomkb.operators import names
from loomkb.plans import registry
from loomkb.session import table

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def brute(docs, forms):
    """Every form at every place between characters that are no part of a word with it."""
    out = []
    for doc_id, text in docs:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "").replace("ё", "е")
        for form, ids in forms.items():
            for m in re.finditer(f"(?={re.escape(form)})", low):
                s, e = m.start(), m.start() + len(form)
                before, after = low[s - 1 : s] if s else "", low[e : e + 1]
                word = lambda c: c.isalnum() or c == "_"
                if not (before and word(before) and word(form[0])) and not (after and word(after) and word(form[-1])):
                    out += [(doc_id, i, s, text[s:e]) for i in ids]
    return sorted(out, key=str)


def test_forms(spark):
    given = spark.createDataFrame([("Варшава",), ("Лондон",), ("Казань",), ("Италия",), ("Нижний  Новгород",), ("Осло",), ("УТ 11",), ("SAP",), ("",), (None,), ("8.3",)], "n string")
    got = {r["n"]: r["f"] for r in given.select("n", names.inflected(F.col("n")).alias("f")).collect()}
    assert got["Варшава"] == ["варшава", "варшаве", "варшаву", "варшавы", "варшавой", "варшави"] and got["Лондон"] == ["лондон", "лондоне", "лондона", "лондону", "лондоном"]
    assert got["Казань"] == ["казань", "казани", "казане", "казанью", "казаня", "казанем"] and got["Италия"] == ["италия", "италии", "италию", "италие", "италией"]
    assert got["Нижний  Новгород"] == ["нижний новгород"] and got["Осло"] == ["осло"] and got["УТ 11"] == ["ут 11"] and got["8.3"] == ["8.3"]
    assert got["SAP"][0] == "sap" and got[""] == [] and got[None] in (None, [])


@pytest.mark.parametrize("shard_bytes", [20, 1 << 20])
def test_every_occurrence(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(names, "SHARD_BYTES", shard_bytes)
    rng = random.Random(1)
    words = ["Ann", "ann", "anna", "Ёлка", "елка", "a-b", "b", "C++", "İx", "x y", "_ann", "9", ".", " ", "  ", "\n", "ann's"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(200)] + [None, "", "ann", "x" * 100_000 + " ann", "ann " * 2000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, "ann again"), (None, "ann")]
    given = [(1, "Ann"), (2, "ann"), (3, "ёлка"), (4, "a-b"), (5, "b"), (6, "c++"), (7, "x y"), (8, ""), (9, None), (None, "x"), (1, "Ann"), (10, "'s"), (11, "ix")]
    forms = {}
    for i, n in given:
        if n and i is not None:
            forms.setdefault(n.lower().replace("ё", "е"), set()).add(i)
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, start string")
    got = names.occurrences(df, spark.createDataFrame(given, "name_id long, name string"), inflect=False)
    assert rows(got) == brute(docs, forms)
    assert names.occurrences(df.limit(0), spark.createDataFrame(given, "name_id long, name string")).count() == 0
    assert names.occurrences(df, spark.createDataFrame([], "name_id long, name string")).count() == 0


def test_contours_by_name_and_alias(spark):
    docs = spark.createDataFrame([(1, "Выгрузили складу и складом, потом БП 3.0"), (2, "ничего"), (3, "Зуп и склад")], "doc_id long, text string")
    contours = spark.createDataFrame([(10, "Склад", ["БП 3.0", "склад"]), (20, "ЗУП", None)], "id long, name string, aliases array<string>")
    assert rows(names.named_contours(docs, contours)) == [(1, 10, 3), (3, 10, 1), (3, 20, 1)]


def test_places(spark):
    places = spark.createDataFrame([("Варшава", "PL", "Europe/Warsaw"), ("Лондон", "GB", "Europe/London")], "city string, country string, zone string")
    learned = spark.createDataFrame([("Питер", "Санкт-Петербург", "RU", "Europe/Moscow")], "said string, city string, country string, zone string")
    none = spark.createDataFrame([("офис",), ("отпуск",)], "word string")
    said = spark.createDataFrame([(1, "Варшаве!"), (2, "лондона"), (3, "питер"), (4, "офис на Тверской"), (5, "Отпуск"), (6, "Нигде"), (7, None), (8, "")], "i long, said string")
    got = rows(names.resolve_places(said, places, learned, none), "i", "city", "zone", "source")
    assert got == [
        (1, "Варшава", "Europe/Warsaw", "directory"), (2, "Лондон", "Europe/London", "directory"), (3, "Санкт-Петербург", "Europe/Moscow", "learned"),
        (4, None, None, "no place"), (5, None, None, "no place"), (6, None, None, "unknown"), (7, None, None, "unknown"), (8, None, None, "unknown"),
    ]


def test_registered_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    forms = {}
    for r in table(spark, SF, "benchmark").collect():
        form = " ".join(r["text"].split()[:3]).lower().replace("ё", "е")
        forms.setdefault(form, set()).add(r["item_id"])
    want = brute(docs, forms)
    assert len(want) >= 3
    assert rows(registry.queries()["name_mentions"](spark, SF), "doc_id", "item_id", "start", "said") == want
