"""Text, scoring and assistant functions on small golden cases."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from loomkb.functions import assistant, chunking, scoring, text, threads

C = F.col


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("one")])
    return df.select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    "make,given,want",
    [
        (text.normalize_whitespace, "a\r\nb \u00a0 \n\n\n\nc\u200b ", "a\nb\n\nc"),
        (text.strip_banners, "External mail : be careful\nhello", "\nhello"),
        (text.strip_signature, "hello\nС уважением,\nИван", "hello"),
        (text.strip_signature, "hello\nThanks!\nBob", "hello"),
        (text.strip_disclaimers, "text\nThis message is confidential and so on", "text"),
        (text.strip_disclaimers, "keep\n\nsome Confidential note for the recipient only\n\nend", "keep\n\nend"),
        (text.tidy_links, "a@b.c <mailto:a@b.c> see <https://x.y/z>", "a@b.c see"),
        (text.mask_pii, "write Ann.B@Corp.Example or +7 (912) 345-67-89 now", "write <email@corp.example> or <телефон> now"),
        (text.mask_pii, "two a@b.cc, c@D.ee", "two <email@b.cc>, <email@d.ee>"),
        (text.dedent_quoted, "> > a\n\tb\n    c", "a\nb\nc"),
        (text.unwrap_safelinks, "go https://eu.safelinks.protection.outlook.com/?url=https%3A%2F%2Fa.b%2Fc&data=1 now", "go https://a.b/c now"),
        (text.thread_subject, "Re: FW[2]: Ответ: Отчет", "Отчет"),
        (text.clean_filename, "29fed8ad-plan.docx", "plan.docx"),
        (text.safe_filename, "C:\\x\\a?b.txt", "a_b.txt"),
        (text.eval_norm, "«Ёлка»  и\nЕль", "елка и ель"),
        (text.guess_doc_type, "Программа и методика испытаний", "pimi"),
        (text.guess_doc_type, "ДС №4", "ds"),
        (text.guess_kind, "Протокол встречи", "protocol"),
        (text.guess_kind, "просто файл", "other"),
        (text.guess_doc_version, "ТЗ ред. 2.1", "2.1"),
        (text.guess_doc_date, "акт 05.11.2024 подписан", dt.date(2024, 11, 5)),
        (text.guess_doc_date, "акт 45.11.2024", None),
        (text.expand_ranges, "1–3, 129; 9-7, x", ["1", "2", "3", "129"]),
        (text.parse_number, "ОБР-0012", 12),
        (text.object_key, "Справочник «Номенклатура контрагентов»", "номенклатураконтрагентов"),
        (text.object_key, "Документ.РеализацияТоваровУслуг", "реализациятоваровуслуг"),
        (text.people, "Анна Б <a@x.ru>; b@y.ru, Анна Б <a@x.ru>", "Анна Б (x.ru); b (y.ru)"),
        (text.text_safe, "a\x00b\x07", "ab"),
        (text.mentioned_numbers, "см. ОБР-0007 и обращение № 9, ОБР 7", [7, 9]),
        (text.title_stems, "Описание процесса_закупок (новая версия).docx", ["описан", "процес", "закупо"]),
        (scoring.priority, "Срочно! не проводится", "high"),
        (scoring.priority, "склад: никто не может работать", "critical"),
        (scoring.category, "всё тормозит", "performance"),
        (scoring.category, "как закрыть месяц", "consult"),
        (assistant.until_time, "работаю до 9.30", "09:30"),
        (assistant.until_time, "до 25", None),
    ],
)
def test_column_functions(spark, make, given, want):
    assert one(spark, make(C("x")), x=given) == want


def test_identity(spark):
    import hashlib

    assert one(spark, text.chunk_id(C("s"), C("t"), C("x")), s="a", t="b", x="c") == hashlib.sha1(b"a\nb\nc").hexdigest()[:16]
    assert one(spark, text.sender_key(C("n"), C("a")), n="Ёлкина Анна", a="z@y") == "елкина"
    assert one(spark, text.sender_key(C("n"), C("a")), n="", a="Bob@y.z") == "bob"
    assert one(spark, text.issue_number(C("n")), n=12) == "ОБР-0012"
    refs = one(spark, text.external_refs(C("x")), x="INC_004567, заявка № 123, [#777] 0000026095")
    assert refs == ["0000026095", "INC-004567", "777", "123"]
    keys = one(spark, text.dedup_keys(C("n"), C("a"), F.lit("2024-05-01 10:37:12").cast("timestamp"), C("b")), n="Bo", a="x@y", b="short")
    assert keys == ["bo|2024-05-01 10:37"]


def test_cleaning_is_idempotent_and_masks_twice_alike(spark):
    body = "Importance: High\nДобрый день, пишите на x@y.zz\n\n--\nподпись"
    once = one(spark, text.clean_email_text(C("x")), x=body)
    assert once == "Добрый день, пишите на <email@y.zz>" == one(spark, text.clean_email_text(C("x")), x=once)


def test_set_similarity(spark):
    a, b = F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "cdef"))
    assert one(spark, text.overlap(a, b)) == 0.5 and one(spark, text.set_cosine(a, b)) == 0.5
    assert one(spark, text.shingles(F.array(*map(F.lit, "abcd")), 3)) == ["a b c", "b c d"]
    assert one(spark, text.shingles(F.array(F.lit("a")), 3)) == ["a"]
    assert one(spark, text.added_lines(C("n"), C("o")), n="old line number one\nbrand new line of answer", o="Old line, number one") == ["brand new line of answer"]


@pytest.mark.parametrize(
    "said,files,primary,issue",
    [
        ("Почему выбрана версия 11?", False, "question", False),
        ("Не проводится реализация, срочно", False, "issue", True),
        ("{Документ.Заказ.МодульОбъекта(245)}: ошибка выполнения запроса", False, "issue", True),
        ("Подготовь письмо поставщику", False, "document", False),
        ("Список всех тестов", False, "summary", False),
        ("К сведению: договорились о сроке", False, "knowledge", False),
        ("Добавь в базу знаний эти файлы", True, "intake", False),
        ("Зарегистрируй обращение по письму", True, "issue_mail", False),
        ("", False, "question", False),
    ],
)
def test_intents(spark, said, files, primary, issue):
    got = one(spark, scoring.intent(C("x"), files), x=said)
    assert (got["primary"], got["is_issue"]) == (primary, issue)


def test_roles_and_results(spark):
    role = scoring.letter_role(C("n"), C("e"), ("corp.example",), ("boss@corp.example",), ("Ivanov",))
    cases = [("Robot", "noreply@x.y"), ("A", "boss@corp.example"), ("Ivanov I", "q@z.z"), ("B", "b@sub.corp.example"), ("C", "c@z.z"), ("D", "")]
    assert [one(spark, role, n=n, e=e) for n, e in cases] == ["notification", "analyst", "analyst", "internal", "external", "unknown"]
    worst = scoring.worst_result(C("x"))
    assert one(spark, worst, x=["ok", "Не работает"]) == "Не работает" and one(spark, worst, x=["ok", "", "ok"]) == "ok"


def test_thread_split():
    body = "Own text\n\nFrom: Ann <ann@a.bb>\nSent: Monday, 5 May 2024 12:24\nTo: Bob\nSubject: Plan\n\nfirst quote\n\n> 04.05.2024 10:37, Пётр П. пишет:\n> second quote"
    own, quoted = threads.split_thread(body)
    assert own.strip() == "Own text" and [q["text"].strip() for q in quoted] == ["first quote", "second quote"]
    assert quoted[0]["subject"] == "Plan" and quoted[0]["date"].hour == 12 and quoted[1]["date"] == dt.datetime(2024, 5, 4, 10, 37)
    assert threads.split_thread(None) == ("", []) and threads.parse_date("пн, 3 мая 2024 г. в 9:05") == dt.datetime(2024, 5, 3, 9, 5)


def test_thread_split_column(spark):
    got = spark.createDataFrame([("a\nOn 1 Jan 2024 10:00, Bob wrote:\n> b",), (None,)], "body string").select(threads.thread_of(C("body")).alias("t")).collect()
    assert got[0]["t"]["own"] == "a" and got[0]["t"]["quoted"][0]["text"] == "b" and got[1]["t"]["quoted"] == []


def test_packing_lines():
    groups = chunking.pack_lines(["a" * 900, "b" * 900, "c" * 900, ("Long sentence. " * 300).strip()])
    assert all(sum(map(len, g)) <= 2000 for g in groups) and sum(len("".join(g)) for g in groups) > 7000
    assert chunking.pack_lines([]) == []


def test_tables():
    def r(*cells, wide=False):
        return {"cells": list(enumerate(cells)), "full_width": wide}

    rows = [r("№", "Функция", "Методика", "Критерий", "Результат"), r("1. Раздел", wide=True), r("1", "вход", "шаг 1", "ок", "да"), r("", "", "шаг 2", "ок", "нет"), r("2.", "выход", "шаг", "ок", "")]
    kind, cases = chunking.table_records(rows, "S")
    assert kind == "pimi" and [c["num"] for c in cases] == ["1", "2"] and len(cases[0]["steps"]) == 2 and cases[0]["section"] == "S / 1. Раздел"
    kind, items = chunking.table_records([r("№", "Наименование объекта", "Процедура проверки"), r("64", "Заказ", "a"), r("64", "", "b")])
    assert kind == "plan" and items == [{"num": "64", "group": "", "object": "Заказ", "procedures": ["a", "b"]}]
    kind, cover = chunking.table_records([r("№", "Документ", "Пункты плана"), r("1", "ТЗ", "64, 70–72")])
    assert kind == "coverage" and cover[0]["items"] == "64, 70–72"
    kind, generic = chunking.table_records([r("A", "B"), r("1", "2"), r("", "3")])
    assert kind == "generic" and [g["values"] for g in generic] == [{"A": "1", "B": "2"}, {"B": "3"}]
    assert chunking.table_records([]) == ("empty", [])


@pytest.mark.parametrize(
    "said,minutes",
    [("час", 60), ("полтора часа", 90), ("1 ч 20 мин", 80), ("сорок пять минут", 45), ("1:30", 90), ("полчаса", 30), ("четверть часа", 15), ("3", 180), ("45", 45), ("13 часов", None), ("привет", None)],
)
def test_durations(said, minutes):
    assert assistant.parse_duration(said) == minutes


def test_days(spark):
    today = dt.date(2024, 10, 16)
    for said, want in (("завтра", 17), ("послезавтра", 18), ("в пятницу", 18), ("через три дня", 19), ("20.10", 20)):
        assert one(spark, assistant.named_day(C("x"), F.lit(today)), x=said) == dt.date(2024, 10, want)
    day = lambda said, today=today: one(spark, assistant.named_day(C("x"), F.lit(today)), x=said)
    assert day("5 января") == dt.date(2025, 1, 5) and day("31.02") is None and day("31.02 в пятницу") is None
    assert day("15 октября") == dt.date(2024, 10, 15) and day("14 октября") == dt.date(2025, 10, 14) and day("14 октября 2023") == dt.date(2023, 10, 14)
    assert day("1.2.30") == dt.date(2030, 2, 1) and day("в среду") == dt.date(2024, 10, 23) and day("через 0 дней") is None and day("ничего") is None
    assert day("29 февраля", dt.date(2024, 3, 5)) is None and day("завтра, 20.10") == dt.date(2024, 10, 17) and day("12.13") is None
    assert one(spark, assistant.named_day(C("x"), F.lit(today)), x=None) is None
    assert one(spark, assistant.duration_minutes(C("x")), x="два часа") == 120
    assert one(spark, assistant.named_day(C("x"), F.lit(today)), x="сегодня") == today
    book = one(spark, assistant.author_title(C("x")), x="Л.Н.Толстой «Война и мир», 1300 страниц")
    assert (book["author"], book["title"], book["pages"]) == ("Л.Н. Толстой", "Война и мир", 1300)
    assert one(spark, assistant.plausible(F.lit(55.7), F.lit(37.6), F.lit(3.0))) and not one(spark, assistant.plausible(F.lit(55.7), F.lit(-120.0), F.lit(3.0)))


def test_signs_lose_no_kind(spark):
    """Kinds as by the patterns alone, on texts put together from pieces of what the patterns want; every rule has signs."""
    assert set(text.DOC_SIGNS) == {name for name, _ in text.DOC_KINDS}
    pieces = """программа программы и методика методики испытаний пми пими ПМИ дополнительное соглашение дс ДС №7 12 техническое Техническим заданием задание тз ТЗ
        бизнес бизнес-требования функциональные требования бт правила ограничения as_is as is to-be TO be описание бизнес процесса схемы процессов бп протокол Решение
        решения совещания итоги встречи инструкция руководство пользователя регламент отчет Отчёт отчётный выгрузка реестр оборотная просто слово the ever past""".split()
    rng = random.Random(3)
    texts = [None, ""] + pieces + [rng.choice(" _\n-").join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(3000)]

    def ruled(rules, t, default):
        low = (t or "").lower().replace("_", " ")
        return next((name for name, pattern in rules if re.search(pattern.replace(r"[\p{L}\p{N}_]", r"\w"), low)), default)

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.guess_kind(C("t")), text.guess_doc_type(C("t"))).collect()
    want = [(i, ruled(text.DOC_KINDS, t, "other"), ruled(text.DOC_TYPES, t, "doc")) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in got) == want and {k for _, k, _ in want} == {*text.DOC_SIGNS, "other"}
