"""Entities and additive evidence on small cases."""

from pyspark.sql import functions as F

from loomkb.functions import entities
from loomkb.operators import evidence


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_entities(spark):
    said = "Платформа 8.3.27.2342, ут 11.5.27.75 на srv1app01; КС_Гамма и «Приказы (КС)», ДС № 10, ТЗ ред. 2, ПМИ; Документ.Заказ и ШтрихкодыТоваров"
    df = spark.createDataFrame([(said,), (None,)], "t string").select(entities.entities(F.col("t")).alias("e"), entities.metadata_objects(F.col("t")).alias("m"))
    first, second = df.collect()
    assert [e["name"] for e in first["e"]] == ["Платформа 8.3.27.2342", "УТ 11.5.27.75", "КС_Гамма", "Приказы (КС)", "ДС № 10", "ТЗ ред. 2", "ПиМИ", "srv1app01"]
    assert first["m"] == ["Документ.Заказ", "КС_Гамма", "ШтрихкодыТоваров"] and second["e"] == [] and second["m"] == []


def test_labels(spark):
    cases = [({"doc_type": "email", "title": "Тема: План", "date": "2024-01-01"}, "письмо «План», 2024-01-01"), ({"doc_title": "ТЗ", "doc_version": "2", "test_case": "7"}, "ТЗ (ред. 2), тест-кейс № 7"), ({}, "first line")]
    df = spark.createDataFrame([(a, "first line\nsecond") for a, _ in cases], "a map<string,string>, t string")
    assert [r[0] for r in df.select(entities.source_label(F.col("a"), F.col("t"))).collect()] == [want for _, want in cases]


def test_related_issues(spark):
    place = "{Документ.Заказ.МодульОбъекта(12)}: упало"
    issues = spark.createDataFrame([(1, "накладная не проводится после смены склада", ["Документ.Заказ"], place), (2, "накладная проводится медленно", ["Заказ"], place), (3, "совсем другое дело", [], "")], "id long, t string, o array<string>, e string")
    d = evidence.described(issues, F.col("t"), F.col("o"), F.col("e"))
    got = rows(evidence.related(d, d, "id", evidence.related_score("l", "r"), evidence.ISSUE_MIN), "l_id", "r_id")
    assert got == [(1, 2), (2, 1)]
    tests = evidence.described(spark.createDataFrame([(31, "проверка накладной", ["Документ «Заказ»"])], "id long, t string, o array<string>"), F.col("t"), F.col("o"))
    assert rows(evidence.related(d, tests, "id", evidence.link_score("l", "r"), evidence.LINK_MIN), "l_id", "r_id") == [(1, 31), (2, 31)]


def test_contours(spark):
    contours = spark.createDataFrame(
        [(1, "system", "Торговля", None, ["УТ 11"]), (2, "subsystem", "Склад", 1, ["Перемещение товаров"]), (3, "subsystem", "Продажи", 1, []), (4, "system", "Сеть", None, ["RDP"])],
        "id long, kind string, name string, parent_id long, aliases array<string>",
    )
    texts = spark.createDataFrame([(1, "в ут 11.5 на складе ошибка", []), (2, "rdp не работает", []), (3, "x", ["Документ.Продажи"]), (4, "склады и продажи", []), (5, None, None)], "id long, t string, o array<string>")
    scores = evidence.contour_scores(texts, contours, "id", "t", "o")
    assert rows(evidence.contour_suggest(scores)) == [(1, [1, 2]), (2, [4]), (3, [1, 3]), (4, [])]
    assert (1, 2, 2.0) in rows(scores, "id", "contour_id", "score")


def test_triage(spark):
    mail = spark.createDataFrame([(1, True), (2, True), (3, False)], "mail_id long, p boolean")
    e = lambda *r: spark.createDataFrame(list(r), "mail_id long, issue_id long, score double, why string")
    found = evidence.candidates([e((1, 7, 1.5, "text"), (2, 9, 1.0, "text")), e((1, 7, 2.5, "ticket"))])
    assert rows(evidence.triage(mail, found, F.col("p"))) == [(1, "update", 7), (2, "new", None), (3, "knowledge", None)]
    kinds = spark.createDataFrame([("new", "doc"), ("known_letters", "mail"), ("new_version", "doc"), ("new", "unsupported")], "r string, k string")
    assert [r[0] for r in kinds.select(evidence.intake_action(F.col("r"), F.col("k"))).collect()] == ["add", "skip", "new_version", "skip"]
