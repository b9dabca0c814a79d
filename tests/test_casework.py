"""Letters, chunks, issues, materials, the assistant and tools on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomkb.functions import commands, lines
from loomkb.operators import chunks, issues, letters, library, secretary, tools

C = F.col
T = dt.datetime


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("o")]).select(column.alias("r")).first()[0]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


LETTER = "letter long, chain long, position int, sender_key string, sent_at timestamp, body string, message_id string, thread long, sender string, origin string, subject string"


def letter(spark, *given):
    return spark.createDataFrame([(*g, *(None,) * (11 - len(g))) for g in given], LETTER)


WORDS = "the quick brown fox jumps over the lazy dog and runs far away from home"


def test_known_letters(spark):
    stored = letter(
        spark, (1, 0, 0, "ann", T(2024, 5, 1, 10, 0), WORDS, "<m1>"), (2, 0, 0, "ann", T(2024, 5, 1, 18, 0), WORDS + " again"), (3, 0, 0, "bob", None, "short note"), (4, 0, 0, "", T(2024, 5, 1, 10, 0), WORDS)
    )
    incoming = letter(
        spark,
        (11, 1, 0, "eve", None, "anything", "<m1>"),  # by its Message-ID
        (12, 1, 1, "ann", T(2024, 5, 1, 13, 1), WORDS.split(" runs")[0]),  # the same minute three hours on, less text
        (13, 1, 2, "ann", T(2024, 5, 1, 13, 30), "the quick brown fox jumps over another fence today and sleeps"),  # too little in common
        (14, 1, 3, "ann", T(2024, 5, 9), WORDS),  # too late
        (15, 1, 4, "bob", T(2024, 5, 1), "short note"),  # of unknown time
        (16, 1, 5, "ann", T(2024, 5, 1, 10, 0), WORDS, "<m2>"),  # another Message-ID than the first one's
        (17, 1, 6, "", T(2024, 5, 1, 10, 0), WORDS),  # nobody
    )
    assert rows(letters.known_letters(incoming, stored), "letter", "known") == [(11, 1), (12, 1), (13, None), (14, None), (15, 3), (16, 2), (17, None)]
    assert letters.known_letters(incoming.limit(0), stored).count() == 0


def test_threads_by_subject(spark):
    chains = spark.createDataFrame([(1, "RE: Plan", T(2024, 5, 1), ["ann"]), (2, "Plan", T(2025, 5, 1), ["ann"]), (3, "Plan", T(2024, 5, 1), ["zed"]), (4, "", T(2024, 5, 1), ["ann"])], "chain long, subject string, newest timestamp, senders array<string>")
    threads = spark.createDataFrame([(5, "plan", T(2024, 4, 1)), (6, "Plan", T(2024, 4, 20)), (7, "Plan", T(2023, 1, 1))], "thread long, subject string, last_at timestamp")
    own = spark.createDataFrame([(5, "ann"), (6, "ann"), (7, "ann")], "thread long, sender_key string")
    assert rows(letters.thread_by_subject(chains, own, threads)) == [(1, 6), (2, None), (3, None), (4, None)]


def test_chains_join_and_merge_threads(spark):
    incoming = letter(spark, *[(i, c, i, "a", None, "x") for i, c in ((1, 10), (2, 10), (3, 11), (4, 11), (5, 12), (6, 13), (7, 13))])
    stored = letter(spark, *[(100 + t, 0, 0, "a", None, "x", None, t) for t in (1, 2, 3, 4)])
    known = spark.createDataFrame([(1, 101), (2, 102), (3, 102), (4, 103), (5, None), (6, 104), (7, None)], "letter long, known long")
    placed, merged = letters.place_chains(incoming, known, stored)
    assert rows(placed) == [(10, 1, 0, 2), (11, 1, 0, 2), (12, None, 1, 0), (13, 4, 1, 1)] and rows(merged) == [(2, 1), (3, 1)]
    threads = spark.createDataFrame([(1, None, [5]), (2, 9, [3, 5]), (3, 8, []), (4, 7, [1])], "thread long, issue long, contours array<long>")
    assert rows(letters.merge_threads(threads, merged)) == [(1, 9, [3, 5]), (4, 7, [1])]
    assert rows(letters.chain_links(incoming), "letter", "parent") == [(1, 2), (2, None), (3, 4), (4, None), (5, None), (6, 7), (7, None)]


def test_summaries(spark):
    own = letter(spark, (1, 0, 0, "a", T(2024, 5, 2), " second ", None, 1, "Ann"), (2, 0, 0, "b", None, "first  " + "x" * 400, None, 1, "Bob"), (3, 0, 0, "b", T(2024, 5, 1), "only", None, 2, None))
    got = rows(letters.thread_summaries(own), "thread", "letters", "problem", "last", "participants")
    assert got == [(1, 2, "first " + "x" * 294 + "…", "Ann: second", "Ann, Bob"), (2, 1, "only", "", "")]
    assert rows(letters.summary_input(own, 60))[1] == (2, "— ?, 01.05.2024 00:00:\nonly")
    old = spark.createDataFrame([(1, 1, "c1"), (2, 1, "c2")], "thread long, letters long, chunk string")
    assert rows(letters.stale_summaries(old, own)) == [(1, 2, "c1")]
    threads = spark.createDataFrame([(1, "Plan A", T(2024, 1, 1)), (2, "plan b", T(2024, 2, 1))], "thread long, title string, last_at timestamp")
    assert letters.find_thread(threads, "PLAN").first()["thread"] == 2 and letters.find_thread(threads, "1").first()["thread"] == 1
    tagged = spark.createDataFrame([(1, [1]), (2, [2])], "thread long, contours array<long>")
    assert rows(letters.apply_contours(tagged, spark.createDataFrame([(2, [7, 8])], tagged.schema))) == [(1, [1]), (2, [7, 8])]


def test_chunk_families(spark):
    base = dict(source="s", doc_title="ТЗ", version="2", doc_type="tz")
    sections = spark.createDataFrame([(*base.values(), "1.1", "Общие", ["a" * 1500, "b" * 1500]), (*base.values(), "2", "Пусто", [])], "source string, doc_title string, version string, doc_type string, section string, title string, paragraphs array<string>")
    got = [tuple(r) for r in chunks.section_chunks(sections).orderBy("title").select("title", "text", "attrs").collect()]
    assert [g[0] for g in got] == ["Общие", "Общие (часть 2)"] and got[0][1].startswith("ТЗ (ред. 2)\nОбщие\n\naaa") and got[0][2]["section"] == "1.1"
    cases = spark.createDataFrame([(*base.values(), "7", "S", "вход", [("шаг", "ок", ""), ("шаг 2", None, "да")], "да")], "source string, doc_title string, version string, doc_type string, num string, section string, function string, steps array<struct<method:string,criterion:string,result:string>>, result string")
    (case,) = chunks.case_chunks(cases).collect()
    assert case["text"] == "ТЗ (ред. 2)\nТест-кейс № 7 — вход\nS\n1. шаг\nКритерий: ок\n2. шаг 2\nРезультат: да" and case["attrs"]["test_case"] == "7"
    plan = spark.createDataFrame([(*base.values(), "64", "", "Заказ", ["a", "b"])], "source string, doc_title string, version string, doc_type string, num string, group string, object string, procedures array<string>")
    assert chunks.plan_chunks(plan).first()["text"].endswith("№ 64 — Заказ\na\nb")
    cover = spark.createDataFrame([(*base.values(), "ДС", "64, 70", "")], "source string, doc_title string, version string, doc_type string, document string, items string, coverage string")
    assert chunks.coverage_chunks(cover).first()["text"].endswith("Документ ДС покрывает пункты плана тестирования: 64, 70.")
    comment = spark.createDataFrame([(*base.values(), "Ann", "2024", "here", "note")], "source string, doc_title string, version string, doc_type string, author string, date string, anchor string, body string")
    assert chunks.comment_chunks(comment).first()["text"].endswith("Комментарий Ann от 2024 к фрагменту «here»:\nnote")
    gone = spark.createDataFrame([(*base.values(), ["x", "y"])], "source string, doc_title string, version string, doc_type string, lines array<string>")
    assert chunks.removed_chunks(gone).first()["text"].endswith("– x\n– y")
    tables = spark.createDataFrame([(*base.values(), "S", [("G", {"A": "1", "B": "2"}), ("", {"A": "3"})])], "source string, doc_title string, version string, doc_type string, section string, rows array<struct<group:string,values:map<string,string>>>")
    assert chunks.table_chunks(tables).first()["text"] == "ТЗ (ред. 2)\nS — таблица\n\n[G] A: 1; B: 2\nA: 3"
    made = chunks.section_chunks(sections)
    fresh = chunks.upsert_chunks(made.limit(1), made)
    assert fresh.count() == 1 and len(fresh.first()["embedding"]) == 64
    assert one(spark, chunks.vector_literal(C("v")), v=[0.5, 1 / 3]) == "[0.5,0.333333]"
    assert json.loads(chunks.dump(made).first()["value"])["attributes"]["doc_title"] == "ТЗ" and chunks.dump(made, 5).first()["value"].endswith("\nТЗ (р")
    hits = chunks.format_hits(made, 3).first()
    assert hits["text"] == "ТЗ " and hits["label"]

    def refuses(texts, is_query):
        if len(texts[0]) > 1000:
            raise ValueError("too long")
        return [[float(len(texts[0]))]]

    assert one(spark, chunks.embedded(C("t"), refuses), t="x" * 3000) == [777.0]

    def counts(texts, is_query):
        if any(len(t) > 1000 for t in texts):
            raise ValueError("too long")
        return [[float(len(t)), float(len(texts))] for t in texts]

    # a batch that is taken is one call; one that is refused goes text by text
    given = spark.createDataFrame([(i, "x" * i) for i in range(1, 101)], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in given.select("i", chunks.embedded(C("t"), counts).alias("v")).collect()}
    assert all(v[0] == i for i, v in got.items()) and max(v[1] for v in got.values()) > 1
    mixed = spark.createDataFrame([(1, "short"), (2, "y" * 3000), (3, None)], "i int, t string").coalesce(1)
    assert {r["i"]: r["v"] for r in mixed.select("i", chunks.embedded(C("t"), counts).alias("v")).collect()} == {1: [5.0, 1.0], 2: [777.0, 1.0], 3: [0.0, 1.0]}


ISSUES = "id long, title string, status string, contact long, message_id string, description string, refs array<string>, contours array<long>"


def test_issues(spark):
    now = F.lit(T(2024, 5, 1))
    known = spark.createDataFrame([(7, "Old", "new", 1, "<a>", "error in order", ["1"], [2]), (8, "Done", "closed", None, None, "", None, [1, 2])], ISSUES)
    drafts = spark.createDataFrame([(1, "Again", None, "<a>"), (2, "Fresh", None, "<b>"), (3, "Twice", None, "<b>"), (4, " ", None, "<c>"), (5, "Solved", "resolved", None)], "draft long, title string, status string, message_id string")
    new, events, seen = issues.create(known, drafts, now, "me")
    assert rows(new, "id", "title", "status", "resolved_at") == [(9, "Fresh", "new", None), (10, "Solved", "resolved", T(2024, 5, 1))] or rows(new, "id", "title") == [(10, "Solved"), (9, "Fresh")]
    assert rows(seen) == [("<a>", 7)] and rows(events, "issue", "actor", "type") == [(10, "me", "created"), (9, "me", "created")]
    said = spark.createDataFrame([(7, T(2024, 5, 2), "ann", " hi\x07 "), (7, T(2024, 5, 2), "ann", "  ")], "issue long, at timestamp, actor string, text string")
    assert rows(issues.comments(said), "issue", "comment") == [(7, "hi")]
    mail = spark.createDataFrame([(7, 1, "Ann", None, "S", " body ", None), (7, 1, "Ann", None, "S", "body", None), (7, 2, None, T(2024, 1, 1), "S", "b", "notes")], "issue long, letter long, sender string, sent_at timestamp, subject string, body string, notes string")
    first = issues.letter_events(events, mail, now)
    assert rows(first, "at", "actor", "comment") == [(T(2024, 1, 1), "?", "b\n\nnotes"), (T(2024, 5, 1), "Ann", "body")]
    assert issues.letter_events(first, mail, now).count() == 0
    contacts = spark.createDataFrame([(1, "Анна", "Отдел")], "id long, name string, organization string")
    files = spark.createDataFrame([(2, 7, "b.txt", 5), (1, 7, "a.txt", 6)], "id long, issue long, filename string, size long")
    history = issues.comments(spark.createDataFrame([(7, T(2024, 5, i), "ann", f"c{i}") for i in range(1, 8)], said.schema)).withColumn("seq", F.lit(1))
    cards = issues.cards(known, contacts, files, history)
    full = cards.where("id = 7").first()
    assert full["initiator"]["name"] == "Анна" and [f["filename"] for f in full["attachments"]] == ["a.txt", "b.txt"] and len(full["events"]) == 7
    short = issues.short_card(cards).where("id = 7").first()
    assert short["comments"] == [f"2024-05-0{i} ann: c{i}" for i in range(3, 8)] and short["initiator"] == "Анна · Отдел" and short["number"] == "ОБР-0007" and short["facts"] == {"description": "error in order"}
    assert issues.attachment(files, known, 7, 2).count() == 1 and issues.attachment(files, known, 8, 2).count() == 0
    contours = spark.createDataFrame([(1, "УТ 11", None), (2, "Продажи", 1)], "id long, name string, parent_id long")
    assert rows(issues.contour_paths(known, contours)) == [(7, "УТ 11 › Продажи"), (8, "УТ 11 › Продажи")]
    near = spark.createDataFrame([(8, 0.9)], "id long, score double")
    assert [r["id"] for r in issues.search(known, near, "ORDER").collect()] == [8, 7] and [r["id"] for r in issues.search(known, near, "order", open_only=True).collect()] == [7]
    assert rows(issues.context("см. ОБР-0007", known, near), "id", "kind") == [(7, "mentioned"), (8, "similar")]
    threads = spark.createDataFrame([(1, None), (2, 5)], "thread long, issue long")
    links = spark.createDataFrame([(7, 1, ["2", "1"]), (7, 2, ["3"])], "issue long, thread long, refs array<string>")
    after, linked = issues.link_mail(threads, known, links)
    assert rows(after) == [(1, 7), (2, 5)] and linked.where("id = 7").first()["refs"] == ["1", "2", "3"]


def test_initiators_and_knowledge(spark):
    mail = spark.createDataFrame(
        [(1, 1, "a", T(2024, 5, 1), "file", "internal"), (1, 2, "b", T(2024, 5, 2), "file", "analyst"), (1, 3, "c", T(2024, 5, 3), "quoted", "external"), (2, 4, "c", T(2024, 5, 3), "file", "external"), (2, 5, "d", None, "file", "unknown"), (3, 6, "b", None, "file", "analyst")],
        "chain long, letter long, sender_key string, sent_at timestamp, origin string, role string",
    )
    assert rows(issues.initiators(mail)) == [(1, 1, "high"), (2, 5, "low"), (3, None, "none")]
    assert one(spark, issues.scrub(C("x"), ["Мария Смирнова", "Дмитрий"], ["Дмитрий"]), x="Мария Смирнова пишет: спросите, Дмитрий, a@b.cc") == "Пользователь пишет: спросите, аналитик, <email@b.cc>"
    solved = spark.createDataFrame(
        [(12, "Ошибка", "bug", "Добрый день!\nНе проводится", "Поле не найдено", "", "", "Обновили", ["Заказ"], T(2024, 5, 1)), (13, "Нет", None, None, None, None, None, " ", [], None)],
        "id long, title string, category string, description string, error_text string, actual string, root_cause string, resolution string, objects array<string>, resolved_at timestamp",
    )
    (made,) = issues.article(solved).collect()
    assert made["text"].startswith("# Решённое обращение ОБР-0012: Ошибка\n\nКатегория: bug · Объекты: Заказ · Решено: 2024-05-01\n\n## Симптом\n\nНе проводится\n\nТекст ошибки:\n\nПоле не найдено")
    assert "Причина не указана." in made["text"] and made["text"].endswith("Ключевые слова: Заказ")
    empty = spark.createDataFrame([], "name string, sha256 string, size long, status string")
    first = issues.publish(empty, issues.article(solved))
    assert first.count() == 1 and issues.publish(first, issues.article(solved)).count() == 0
    assert one(spark, issues.title_of(C("x")), x="Добрый день!\nПри проведении ошибка. Ещё текст") == "При проведении ошибка"


def test_library(spark):
    assert one(spark, library.clean_aliases(C("x")), x=[" УТ ", "ут", "", "ERP"]) == ["УТ", "ERP"]
    contours = spark.createDataFrame([(1, "system", "УТ 11", None, [])], "id long, kind string, name string, parent_id long, aliases array<string>")
    given = spark.createDataFrame([("system", "ут 11", None, []), ("subsystem", "Склад", 1, ["w", "W"]), ("subsystem", "X", None, []), ("subsystem", "Y", 99, []), ("other", "Z", None, []), ("system", " ", None, [])], "kind string, name string, parent_id long, aliases array<string>")
    good, bad = library.add_contours(contours, given)
    assert rows(good) == [("subsystem", "Склад", 1, ["w"])] and sorted(r["error"] for r in bad.collect()) == ["exists", "kind", "name", "parent missing", "parent unknown"]
    changed = library.update_contours(contours, spark.createDataFrame([(1, " УТ 12 ", ["a", "A"], 1)], "id long, name string, aliases array<string>, parent_id long"))
    assert rows(changed, "name", "aliases", "parent_id") == [("УТ 12", ["a"], None)]
    docs = spark.createDataFrame([(1, "Описание процесса закупок", "doc"), (2, "Другое", "doc")], "id long, title string, kind string")
    assert rows(library.similar_titles(docs, "Описание процесса закупок ред 2", "doc")) == [(1, 1.0)] and library.similar_titles(docs, "Описание процесса", "tz").first()["score"] == 0.8
    own = spark.createDataFrame([("T", "a.docx", ["b.eml#att0"]), ("U", "b.eml#att1", ["b.eml"])], "title string, source string, aliases array<string>")
    assert rows(library.where_already(own, "b.eml")) == [("T", "a.docx")]
    assert one(spark, library.sanitize_query(C("q"), library.blocked_terms(["big-corp.ru"], ["Иван Петров"])), q="ошибка big corp у Петров a@b.cc 192.168.1.5 версия 11.5.27.75 srv.local") == "ошибка у версия 11.5.27.75"
    assert one(spark, library.sanitize_query(C("q")), q="a@b.cc") is None
    assert [one(spark, library.public_host(C("h"), ["corp.ru"]), h=h) for h in ("ya.ru", "localhost", "x.corp.ru", "10.0.0.1", "a.lan", "")] == [True, False, False, False, False, False]


def test_evaluation(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"id": "a", "question": "q", "evidence": ["x"], "answer_must_contain": ["«Ёлка»", "две"]}, {"id": "b", "question": "r"}]), encoding="utf-8")
    cases = library.load_cases(spark, str(path))
    answers = spark.createDataFrame([("a", "тут елка"), ("b", "")], "id string, answer string")
    assert rows(library.check_answers(cases, answers)) == [("a", ["две"], False)]
    results = spark.createDataFrame([("a", True, False, None), ("b", False, None, None), ("c", None, None, "boom"), ("d", True, True, "")], "id string, retrieval_hit boolean, answer_ok boolean, error string")
    assert [r["line"] for r in library.eval_report(results).collect()] == ["cases: 4 recall: 0.667 answers: 0.5 errors: 1", "answer a", "search b", "! c: boom"]


def test_assistant_registers(spark):
    s = spark.createDataFrame([("p", "running", T(2024, 5, 1, 10), None), ("q", "finished", T(2024, 5, 1, 9), T(2024, 5, 1, 10))], "person string, status string, started_at timestamp, finished_at timestamp")
    stops = spark.createDataFrame([("p", T(2024, 5, 1, 9)), ("p", T(2024, 5, 1, 11)), ("p", T(2024, 5, 1, 12))], "person string, at timestamp")
    assert rows(secretary.stop_sessions(s, stops))[0] == ("p", "stopped", T(2024, 5, 1, 10), T(2024, 5, 1, 11))
    starts = spark.createDataFrame([("p", T(2024, 5, 1, 10), None, "14:00", "Europe/Moscow"), ("p", T(2024, 5, 1, 10), None, "12:00", "Europe/Moscow"), ("p", T(2024, 5, 1, 10), 25, None, "UTC"), ("p", T(2024, 5, 1, 10), None, None, "UTC")], "person string, at timestamp, minutes int, until string, tz string")
    assert rows(secretary.session_ends(starts), "minutes", "error") == [(25, None), (60, None), (None, "no length"), (None, "past")]
    running = s.where("person = 'p'").withColumn("ends_at", F.lit(T(2024, 5, 1, 11)))
    assert rows(secretary.session_status(running, F.lit(T(2024, 5, 1, 10, 30, 30)))) == [("p", 30, 30)]
    schema = "person string, place long, body string, kind string, local_day date, at timestamp, text string, status string"
    day = dt.date(2024, 5, 1)
    planned = spark.createDataFrame([("p", 1, "sun", "rise", day, T(2024, 5, 1, 4), "old", "sent"), ("p", 1, "moon", "rise", day, T(2024, 5, 1, 5), "old", "skipped")], schema)
    again = spark.createDataFrame([("p", 1, b, "rise", day, T(2024, 5, 1, 6), "new", None) for b in ("sun", "moon", "mars", "mars")], schema)
    state = secretary.plan_events(planned, again)
    assert rows(state, "body", "text", "status") == [("mars", "new", "pending"), ("moon", "new", "pending"), ("sun", "old", "sent")]
    assert rows(secretary.plan_events(state, again)) == rows(state)
    places = spark.createDataFrame([("p", T(2024, 4, 1), "Paris", "Europe/Paris")], "person string, effective_at timestamp, city string, tz string")
    go = spark.createDataFrame([("p", T(2024, 5, 1, 10), "Paris", "Europe/Paris", None), ("p", T(2024, 5, 1, 10), "Warsaw", "Europe/Warsaw", dt.date(2024, 5, 3))], "person string, at timestamp, city string, tz string, on_date date")
    assert rows(secretary.moves(places, go)) == [("p", "Warsaw", "Europe/Warsaw", T(2024, 5, 2, 22))]
    books = spark.createDataFrame([(1, "p", 1, "Война и мир", "reading", 200)], "id long, person string, num int, title string, status string, total_pages int")
    log = spark.createDataFrame([(1, 1, T(2024, 5, 1), 20, "UTC"), (2, 1, T(2024, 5, 2), 50, "UTC")], "id long, book long, at timestamp, page int, tz string")
    toc = spark.createDataFrame([(1, "One", 1, 1), (1, "Two", 40, 2)], "book long, title string, page int, entry int")
    assert rows(secretary.page_marks(log, books), "id", "delta", "percent") == [(1, None, 10), (2, 30, 25)]
    assert rows(secretary.books_table(books, log, toc), "page", "section", "toc_count", "last_text") == [(50, "Two", 2, "02.05.2024 00:00")]
    state, counts = secretary.upsert_toc(toc, spark.createDataFrame([(1, "Two", 45, 1), (1, "Three", 90, 2)], toc.schema))
    assert rows(state, "title", "page") == [("One", 1), ("Three", 90), ("Two", 45)] and rows(counts) == [(1, 1, 1)]
    assert rows(secretary.delete_latest(log, 1), "id") == [(1,)] and rows(secretary.delete_latest(log, 1, 20), "id") == [(2,)]
    assert secretary.find_book(books, title="о мире").count() == 0 and secretary.find_book(books, title="Война").count() == 1 and secretary.find_book(books).count() == 1 and secretary.find_book(books, 2).count() == 0
    put = secretary.put_settings(spark.createDataFrame([("p", True, False, True)], "person string, astro boolean, planets boolean, stars boolean"), spark.createDataFrame([("p", None, None, False), ("q", False, None, None)], "person string, astro boolean, planets boolean, stars boolean"))
    assert rows(put) == [("p", True, False, False), ("q", False, True, True)]
    assert rows(secretary.state(books.select("person"), running, places, books, F.lit(T(2024, 5, 1, 10, 30))), "city", "minutes_left", "reading") == [("Paris", 30, ["Война и мир"])]
    assert one(spark, secretary.weather_text(F.lit(12.4), F.lit(9.6), F.lit("Облачно."), F.lit(4.2), F.lit(81))) == "+12 °C, ощущается как +10, облачно, ветер 4 м/с, влажность 81 %"
    zones = spark.createDataFrame([(1, "RU,UA", "x", "Europe/Moscow"), (2, "RU", "y", "Asia/Omsk")], "line int, codes string, place string, zone string")
    assert rows(secretary.country_zones(zones)) == [("RU", ["Europe/Moscow", "Asia/Omsk"]), ("UA", ["Europe/Moscow"])]


@pytest.mark.parametrize(
    "said,want",
    [
        ("я в Варшаве", [("place", None, None, "Варшаве", "arrive")]),
        ("завтра еду в Лондон", [("place", None, None, "Лондон", "depart")]),
        ("работаем час", [("work", 60, None, None, None)]),
        ("перерыв 15 минут", [("rest", 15, None, None, None)]),
        ("работаю до 18:30", [("work", None, "18:30", None, None)]),
        ("закончил работу", [("stop", None, None, None, None)]),
        ("стоп", [("stop", None, None, None, None)]),
        ("сколько осталось", [("status", None, None, None, None)]),
        ("который час", [("where", None, None, None, None)]),
        ("не еду", [("cancel_trip", None, None, None, None)]),
        ("где я был", [("history", None, None, None, None)]),
        ("помощь", [("help", None, None, None, None)]),
        ("мы вернулись в понедельник в Нижний Новгород на поезде", [("place", None, None, "Нижний Новгород", "arrive")]),
        ("в Лондоне", [("place", None, None, "Лондоне", "arrive")]),
        ("еду в пятницу, 5 часов", []),
        ("в 10:00 еду во Владивосток", [("place", None, None, "Владивосток", "depart")]),
        ("хватит работать", [("stop", None, None, None, None)]),
        ("отдыхаем, потом работаем 20 минут", [("rest", 20, None, None, None)]),
        ("выключи звёзды", [("sky_set", None, None, None, None)]),
        ("", []),
        ("абракадабра", []),
    ],
)
def test_commands(spark, said, want):
    got = one(spark, commands.parsed_commands(C("t"), F.lit(dt.date(2024, 10, 16))), t=said)
    assert [(c["action"], c["minutes"], c["until"], c["place"], c["direction"]) for c in got] == want


def test_commands_as_a_column(spark):
    got = one(spark, commands.parsed_commands(C("t"), F.lit(dt.date(2024, 10, 16))), t="завтра еду в Лондон, работаем час")
    assert [c["action"] for c in got] == ["place", "work"] and got[0]["day"] == dt.date(2024, 10, 17)
    sky = one(spark, commands.parsed_commands(C("t"), F.lit(dt.date(2024, 10, 16))), t="включи планеты")
    assert [(c["action"], c["target"], c["on"]) for c in sky] == [("sky_set", "planets", True)]


def test_lines(spark):
    assert one(spark, lines.join_lines(C("x")), x=["Первая стро-", "ка идёт", "дальше.", "новая", "Другая"]) == ["Первая строка идёт дальше.", "новая", "Другая"]
    assert one(spark, lines.join_lines(C("x")), x=[]) == []
    head = lambda a, b=None: one(spark, lines.heading(F.lit(a), F.lit(b).cast("string")))
    assert tuple(head("2.1 Требования")) == (2, "2.1 Требования") and tuple(head("Приложение А")) == (1, "Приложение А")
    assert head("2.1 Требования", "и ещё") is None and head("2.1 Требования:") is None and head("1 Акт 05.11.2024") is None and head("текст") is None


def test_functions_in_sql_and_tools(spark):
    tools.register_functions(spark)
    assert spark.sql("SELECT duration_minutes('два часа') AS m, letter_date('5 мая 2024 10:30') AS d").first() == (120, T(2024, 5, 5, 10, 30))
    assert spark.sql("SELECT k, middle(v) AS m FROM VALUES ('a', 1D), ('a', 5D), ('a', 2D) AS t(k, v) GROUP BY k").first() == ("a", 2.0)
    got = spark.sql("SELECT position, sender, text FROM quoted_letters('own' || chr(10) || 'On 1 Jan 2024 10:00, Bob wrote:' || chr(10) || '> b')").collect()
    assert [tuple(r) for r in got] == [(0, None, "own"), (1, "Bob", "b")]
    table = tools.tool_table(spark, "/root/testdata/sf0.001")
    assert [t["name"] for t in tools.available(table)] == ["sql"] and len(tools.available(table, search=1, modules=1)) == 4
    schema = tools.available(table, search=1)[1]["parameters"]
    assert schema["required"] == ["query", "filters", "k"] and schema["properties"]["k"]["type"] == ["integer", "null"]
    assert json.loads(tools.call(table, "sql", '{"query": "SELECT count(*) AS n FROM region"}')) == [{"n": 5}]
    assert "error" in json.loads(tools.call(table, "sql", '{"query": "DROP TABLE region"}')) and "error" in json.loads(tools.call(table, "none", ""))

    def model(messages, offered):
        return {"answer": messages[-1]["content"]} if messages[-1]["role"] == "tool" else {"tool": "sql", "arguments": '{"query": "SELECT 1 AS one"}'}

    assert tools.run_agent("q", table, model)["answer"] == '[{"one": 1}]'


def test_intake(spark, tmp_path):
    import io
    import zipfile

    from loomkb.functions import threads
    from loomkb.operators import intake

    xml = "<y><response><results><grouping><group><doc><url>u1</url><domain>d</domain><title>T1</title><passages><passage>snip</passage></passages></doc></group></grouping></results></response></y>"
    pages = spark.createDataFrame([("q", xml), ("e", "<y><response><error code='15'>no</error></response></y>")], "query string, xml string")
    assert rows(intake.search_results(pages)) == [("q", 0, "T1", "u1", "d", "snip")]
    uneven = """<y><response><results><grouping>
        <group><doc id="1"><url>http://a.org/x?q=1&amp;z=2</url><title>A <hlword>B</hlword>
          C</title><passages><passage>one <hlword>two</hlword></passage><passage/><passage>three</passage></passages></doc></group>
        <group><doc><title>no address</title></doc></group>
        <group><doc id="2"><url>u2</url><domain>d2</domain><headline>head</headline></doc></group></grouping></results></response></y>"""
    got = rows(intake.search_results(spark.createDataFrame([("q", uneven), ("n", None), ("z", "<y/>"), ("x", "<y><doc><url>cut</url></doc><doc><url>off")], "query string, xml string")))
    assert got == [("q", 0, "A B C", "http://a.org/x?q=1&z=2", "a.org", "one two … three"), ("q", 1, "u2", "u2", "d2", "head"), ("x", 0, "cut", "cut", "", "")]
    assert rows(intake.search_results(spark.createDataFrame([("q", uneven)], "query string, xml string"), k=1), "place", "title") == [(0, "A B C")]
    files = spark.createDataFrame([(1, i, f"h{i % 12}", "x" * 5000) for i in range(14)], "message long, position int, sha256 string, text string")
    shown = intake.attachment_texts(files)
    assert shown.count() == 10 and shown.agg(F.sum(F.length("shown"))).first()[0] == 30_000
    ents = spark.createDataFrame([("c", "Заказ", "k1"), ("c", "Склад", "k2"), ("d", "Склад", "k3")], "chunk string, name string, key string")
    rels = spark.createDataFrame([("c", "заказ", "Склад", "uses"), ("c", "заказ", "Нет", "uses")], "chunk string, source string, target string, kind string")
    assert rows(intake.resolved_relations(ents, rels)) == [("c", "k1", "uses", "k2")]
    body = "Добрый день\nС уважением,\nИван Петров\nБухгалтер\nООО Ромашка\n+7 912 345-67-89"
    assert tuple(one(spark, intake.signature(C("b"), C("n")), b=body, n="Иван Петров")) == ("Бухгалтер", "+7 912 345-67-89", "ООО Ромашка")
    assert [tuple(x) for x in one(spark, intake.toc_lines(C("t")), t="Глава первая .... 5\nпросто строка\nГлава 2 — 17")] == [("Глава первая", 5), ("Глава 2", 17)]
    mail = spark.createDataFrame([("m.eml", "Ann", T(2024, 5, 1), "S", "a\nOn 1 Jan 2024 10:00, Bob wrote:\n> b")], "source string, sender string, sent_at timestamp, subject string, body string").withColumn("t", threads.thread_of(C("body")))
    assert rows(intake.chain_rows(mail), "part", "origin", "sender", "text") == [("m.eml#quote1", "quoted", "Bob", "b"), ("m.eml", "file", "Ann", "a")]
    items = spark.createDataFrame([(1, "a.docx", "tz", "", "new", "add")], "position int, filename string, kind string, about string, relation string, action string")
    assert intake.file_block(items).first()["line"] == "1. a.docx — tz; new; → add"
    for _ in range(2):
        intake.journal(ents, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    asked = spark.createDataFrame([("a", T(2024, 5, 1, 10)), ("b", T(2024, 5, 1, 10))], "city string, at timestamp")
    had = spark.createDataFrame([("a", T(2024, 5, 1, 9, 55), "sun"), ("b", T(2024, 5, 1, 9), "rain")], "city string, answered_at timestamp, answer string")
    fresh, again = intake.cached(asked, had, ["city"])
    assert rows(fresh, "city", "answer") == [("a", "sun")] and rows(again, "city") == [("b",)]
    known = spark.createDataFrame([("system", "УТ")], "kind string, name string")
    assert rows(intake.seed(spark, known, [("system", "УТ"), ("system", "ERP")], ["kind", "name"])) == [("system", "ERP")]
    words = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "query long, word string")
    assert rows(intake.any_word_query(words)) == [(1, "a | b")]
    with_project = known.withColumn("project", F.lit("p"))
    assert intake.in_project(with_project, "p").count() == 1 and intake.in_project(with_project, "q").count() == 0
    made = zipfile.ZipFile(io.BytesIO(intake.package("ask", spark.createDataFrame([("n", "Иван a@b.cc")], "name string, text string"), ["Иван"])))
    assert made.read("materials/n.md").decode() == "Пользователь <email@b.cc>" and sorted(made.namelist()) == ["MANIFEST.json", "PROMPT.md", "materials/n.md"]
    with pytest.raises(ValueError):
        intake.package("ask", spark.createDataFrame([("n", "x" * 100)], "name string, text string"), most=50)
