"""Stems, postings and cover density against brute force."""

import re

import pytest

from loomkb.functions import stemming
from loomkb.operators import fulltext
from loomkb.plans import registry
from loomkb.session import table

SF = "/root/testdata/sf0.001"

RUSSIAN = {
    "вавиловка": "вавиловк", "вагоне": "вагон", "вагонов": "вагон", "важная": "важн", "важнее": "важн", "важнейшие": "важн", "важно": "важн", "важного": "важн",
    "вазах": "ваз", "валандался": "валанда", "валериановых": "валерианов", "валерию": "валер", "валится": "вал", "вальдшнепа": "вальдшнеп", "падать": "пада",
    "падающие": "пада", "пакостными": "пакостн", "палатой": "палат", "палкой": "палк", "в": "в", "павел": "павел", "прочитавши": "прочита", "ёлка": "елк", "жалость": "жалост", "конь": "кон",
}
ENGLISH = {
    "consigned": "consign", "consistency": "consist", "consistently": "consist", "consolation": "consol", "knightly": "knight", "knots": "knot", "generalization": "general",
    "happy": "happi", "skies": "sky", "dying": "die", "news": "news", "hopping": "hop", "hoping": "hope", "flies": "fli", "ties": "tie", "gas": "gas", "kiwis": "kiwi",
    "agreed": "agre", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "formality": "formal", "electrical": "electr",
    "adoption": "adopt", "controlling": "control", "rate": "rate", "youth": "youth", "enjoyed": "enjoy", "by": "by", "inning": "inning", "generously": "generous", "communication": "communic",
}


@pytest.mark.parametrize("word, stem", RUSSIAN.items())
def test_russian(word, stem):
    assert stemming.russian(word) == stem


@pytest.mark.parametrize("word, stem", ENGLISH.items())
def test_english(word, stem):
    assert stemming.english(word) == stem


def test_lexemes():
    assert list(stemming.lexemes("Ошибки в 8.3.27.2342, Заказов_2 и the Orders!")) == [(1, "ошибк"), (3, "8.3.27.2342"), (4, "заказ"), (5, "2"), (8, "order")]
    assert fulltext.query_lexemes("orders ordered order") == ["order"]


DOCS = [
    (1, "Заказ покупателя", "Ошибка заказа при печати"),
    (2, None, "печать без ошибок. Печать заказов и ещё раз печать заказа"),
    (3, "", ""),
    (4, None, None),
    (5, "orders", "an order of printers " * 400),
    (6, None, "ошибки " + "слово " * 30 + "печати"),
    (6, None, "другая строка с тем же номером: печать"),
    (None, None, "печать без номера"),
]


def brute(docs, query, every):
    words, out = fulltext.query_lexemes(query), {}
    for doc_id, title, body in docs:
        found = [(p, w) for p, w in stemming.lexemes(" ".join(t for t in (title, body) if t)) if w in words]
        if not every:
            if found:
                out[doc_id] = out.get(doc_id, 0) + 0.1 * len(found)
            continue
        total = 0.0
        for i in range(len(found)):  # the shortest stretch from i that has all, if none inside it has
            ends = [j for j in range(i, len(found)) if {w for _, w in found[i : j + 1]} == set(words)]
            if ends and {w for _, w in found[i + 1 : ends[0] + 1]} != set(words):
                total += 0.1 / (1 + found[ends[0]][0] - found[i][0] - (ends[0] - i))
        if total:
            out[doc_id] = total
    return out


@pytest.mark.parametrize("query", ["печать заказа", "Заказы", "ошибка печати", "order printer", "нигде", "и в на", ""])
@pytest.mark.parametrize("every", [False, True])
def test_search_equals_brute_force(spark, tmp_path_factory, query, every):
    docs = [d for d in DOCS if d != DOCS[6]] if every else DOCS
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    df = spark.createDataFrame(docs, "id long, title string, body string")
    fulltext.write_index(df.limit(4), path, "id", "title", "body", buckets=5)
    fulltext.write_index(df.offset(4), path, "id", "title", "body", buckets=5, mode="append")
    got = {r["id"]: r["score"] for r in fulltext.search(spark, path, query, every, buckets=5).collect()}
    assert got == pytest.approx(brute(docs, query, every))


def test_only_folders_of_the_query_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    fulltext.write_index(spark.createDataFrame([(i, f"word{i} other{i}") for i in range(200)], "id long, body string"), path, "id", "body", buckets=16)
    found = fulltext.find(spark, path, "word7", buckets=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*lexeme", plan)
    assert [r["id"] for r in found.collect()] == [7]


def test_registered_rank_equals_brute_force(spark):
    from loomkb.plans.retrieval import QUESTION

    docs = [(r["doc_id"], None, r["text"]) for r in table(spark, SF, "documents").collect()]
    some, all_of_them = brute(docs, QUESTION, False), brute(docs, QUESTION, True)
    got = {r["doc_id"]: (r["any_score"], r["all_score"]) for r in registry.queries()["fulltext_rank"](spark, SF).collect()}
    assert len(got) > 20 and {k: v[0] for k, v in got.items()} == pytest.approx(some)
    assert {k: v[1] for k, v in got.items() if v[1] is not None} == pytest.approx(all_of_them)


def test_an_index_reads_its_texts_once(spark, tmp_path):
    """Dealing postings by ranges read every text a second time, to find the ranges; a folder still is written by several tasks."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"word{i % 7} common") for i in range(300)], "id long, body string").mapInArrow(counted, "id long, body string")
    path = f"file://{tmp_path}/i"
    fulltext.write_index(docs, path, "id", "body", buckets=3)
    assert read.value == 300
    assert sorted(r["id"] for r in fulltext.find(spark, path, "common", buckets=3).collect()) == list(range(300))
