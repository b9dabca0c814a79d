"""Issues with their history, attachments and contacts, and knowledge drawn from them.

Tables: issues (id, title, status, ...), events (issue, at, seq, actor, type,
field, old_value, new_value, comment), attachments (id, issue, sha256, ...),
contacts (id, name, organization, email). Writers return the rows to append.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkb.functions import text
from loomkb.operators import registry

# Statuses, limits and thresholds that define the results.
OPEN = ("new", "in_progress", "waiting", "on_hold")
RESOLVED = ("resolved", "closed")
LETTER_CHARS, LAST_COMMENTS, BY_TEXT, CONTEXT_MIN, CONTEXT_MOST = 20_000, 5, 0.3, 0.45, 3
ROLES_FIRST = ("internal", "unknown", "external")
EVENT = "issue long, at timestamp, actor string, type string, field string, old_value string, new_value string, comment string"


def _event(issue: Column, at: Column, actor: Column, kind: str, new: Column, comment: Column) -> list[Column]:
    none = F.lit(None).cast("string")
    named = {"issue": issue, "at": at, "actor": actor, "type": F.lit(kind), "field": none, "old_value": none, "new_value": new, "comment": comment}
    return [c.alias(name) for name, c in named.items()]


def create(issues: DataFrame, incoming: DataFrame, now: Column, actor: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to append, their events, ids already there) for drafts (title, status, message_id, ...).

    A draft whose message was registered before gives the issue that exists;
    of several new drafts with one message the first stays. Titles must not be
    empty. Numbers go on after the largest one; resolved drafts are stamped.
    """
    titled = incoming.where(F.trim(F.coalesce("title", F.lit(""))) != "")
    seen = titled.where("message_id IS NOT NULL").join(issues.select(F.col("id").alias("issue"), "message_id"), "message_id").select("message_id", "issue")
    fresh = titled.join(issues.select("message_id"), "message_id", "left_anti")
    keyed = fresh.withColumn("__k", F.coalesce(F.concat(F.lit("m"), "message_id"), F.concat(F.lit("d"), F.col("draft").cast("string"))))
    one = registry.first_of(keyed, ["__k"], [F.col("draft")]).drop("__k")
    top = issues.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rows = registry.consecutive(one, ["draft"], "id", top)
    rows = rows.withColumn("status", F.coalesce("status", F.lit("new"))).withColumn("resolved_at", F.when(F.col("status").isin(*RESOLVED), now))
    made = F.to_json(F.struct("title", "status"))
    events = rows.select(*_event(F.col("id"), now, F.lit(actor).cast("string"), "created", made, F.lit(None).cast("string")))
    return rows, events, seen


def comments(incoming: DataFrame) -> DataFrame:
    """Events of comments (issue, at, actor, text) that say something."""
    said = F.trim(text.text_safe(F.col("text")))
    return incoming.where(said != "").select(*_event(F.col("issue"), F.col("at"), F.col("actor"), "comment", F.lit(None).cast("string"), said))


def letter_events(events: DataFrame, letters: DataFrame, now: Column) -> DataFrame:
    """Events of letters (issue, letter, sender, sent_at, subject, body, notes) that the history does not have yet, at the time they were sent."""
    have = events.where("type = 'letter'").select("issue", F.get_json_object("new_value", "$.letter_id").alias("letter_id"))
    named = letters.withColumn("letter_id", F.col("letter").cast("string")).join(have, ["issue", "letter_id"], "left_anti").dropDuplicates(["issue", "letter_id"])
    body = F.concat(text.text_safe(F.trim("body")), F.coalesce(F.concat(F.lit("\n\n"), text.text_safe(F.col("notes"))), F.lit("")))
    new = F.to_json(F.struct("letter_id", "subject"))
    return named.select(*_event(F.col("issue"), F.coalesce("sent_at", now), F.coalesce("sender", F.lit("?")), "letter", new, F.left(body, F.lit(LETTER_CHARS))))


def attach(attachments: DataFrame, incoming: DataFrame) -> DataFrame:
    """Files (issue, sha256, filename, size) to append: the same content once for each issue."""
    return registry.append_new(attachments.select("issue", "sha256"), incoming, ["issue", "sha256"], [F.col("filename")])


def attachment(attachments: DataFrame, issues: DataFrame, issue: int, file: int) -> DataFrame:
    """The attachment of that number, if the issue is there and has it."""
    return attachments.where((F.col("id") == file) & (F.col("issue") == issue)).join(issues.select(F.col("id").alias("issue")), "issue", "left_semi")


def cards(issues: DataFrame, contacts: DataFrame, attachments: DataFrame, events: DataFrame) -> DataFrame:
    """Issues with initiator, attachments (by id) and events (by time, then number) nested."""
    files = attachments.groupBy(F.col("issue").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "filename", "size"))).alias("attachments"))
    history = events.groupBy(F.col("issue").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("at", "seq", "actor", "type", "field", "old_value", "new_value", "comment"))).alias("events")
    )
    who = contacts.select(F.col("id").alias("__contact"), F.struct("name", "organization").alias("initiator"))
    out = issues.join(who, issues["contact"] == F.col("__contact"), "left").drop("__contact")
    return out.join(files, "id", "left").join(history, "id", "left")


def short_card(card: DataFrame) -> DataFrame:
    """(id, number, title, status, initiator, comments, facts) of cards: the last five comments, and the fields that are not empty as a map."""
    said = F.filter("events", lambda e: (e["type"] == "comment") & (F.coalesce(e["comment"], F.lit("")) != ""))
    last = F.transform(F.slice(said, F.greatest(F.size(said) - (LAST_COMMENTS - 1), F.lit(1)), LAST_COMMENTS), lambda e: F.concat(F.date_format(e["at"], "yyyy-MM-dd"), F.lit(" "), F.coalesce(e["actor"], F.lit("")), F.lit(": "), F.left(e["comment"], F.lit(300))))
    fields = [c for c in ("category", "priority", "assignee", "description", "error_text", "root_cause", "resolution") if c in card.columns]
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.left(F.col(c).cast("string"), F.lit(1500)).alias("value")) for c in fields]) if fields else F.array()
    facts = F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")) if fields else F.lit(None)
    who = F.nullif(F.concat_ws(" · ", F.nullif("initiator.name", F.lit("")), F.nullif("initiator.organization", F.lit(""))), F.lit(""))
    return card.select("id", text.issue_number(F.col("id")).alias("number"), "title", "status", who.alias("initiator"), F.coalesce(last, F.array()).alias("comments"), facts.alias("facts"))


def contour_paths(issues: DataFrame, contours: DataFrame) -> DataFrame:
    """(id, system): labels of an issue's contours; a system is hidden where one of its blocks is chosen."""
    parents = contours.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    named = contours.join(parents, "parent_id", "left").select(F.col("id").alias("contour"), "parent_id", F.concat_ws(" › ", "parent_name", "name").alias("label"))
    chosen = issues.select("id", F.explode(F.array_distinct("contours")).alias("contour")).join(named, "contour")
    hidden = chosen.select("id", F.col("parent_id").alias("contour")).where("contour IS NOT NULL")
    shown = chosen.join(hidden, ["id", "contour"], "left_anti")
    return shown.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("system"))


def search(issues: DataFrame, similar: DataFrame, query: str, open_only: bool = False, k: int = 5) -> DataFrame:
    """(id, score, why) of the best ``k``: likeness scores (id, score) first, then issues whose title or description has the text."""
    by_text = issues.where(F.contains(F.lower(F.concat_ws("\n", "title", "description")), F.lit(query.lower()))).select("id", F.lit(BY_TEXT).alias("score"), F.lit("text").alias("why"))
    both = similar.select("id", "score", F.lit("similar").alias("why")).unionByName(by_text)
    best = both.groupBy("id").agg(F.min_by(F.struct("score", "why"), F.struct(F.col("why") != "similar", -F.col("score"))).alias("b")).select("id", "b.*")
    wanted = issues.where(F.col("status").isin(*OPEN)) if open_only else issues
    return best.join(wanted.select("id"), "id", "left_semi").orderBy(F.col("score").desc(), "id").limit(k)


def context(question: str, issues: DataFrame, similar: DataFrame) -> DataFrame:
    """(id, kind, score) of issues that the question mentions, and of at most three like it (0.45 and more)."""
    spark = issues.sparkSession
    mentioned = spark.range(1).select(F.explode(F.array_distinct(text.mentioned_numbers(F.lit(question)))).alias("id")).select(F.col("id").cast("long").alias("id"))
    named = mentioned.join(issues.select("id"), "id", "left_semi").select("id", F.lit("mentioned").alias("kind"), F.lit(None).cast("double").alias("score"))
    near = similar.where(F.col("score") >= CONTEXT_MIN).join(mentioned, "id", "left_anti").orderBy(F.col("score").desc(), "id").limit(CONTEXT_MOST)
    return named.unionByName(near.select("id", F.lit("similar").alias("kind"), F.col("score").cast("double").alias("score")))


def link_mail(threads: DataFrame, issues: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, issues) after linking letters' threads (issue, thread, refs) to issues: a thread takes an issue if it has none, references unite."""
    first = links.groupBy("thread").agg(F.min("issue").alias("__issue"))
    t = threads.join(first, "thread", "left").withColumn("issue", F.coalesce("issue", "__issue")).drop("__issue")
    refs = links.groupBy(F.col("issue").alias("id")).agg(F.flatten(F.collect_list("refs")).alias("__refs"))
    i = issues.join(refs, "id", "left").withColumn("refs", registry.unite(F.col("refs"), F.col("__refs"))).drop("__refs")
    return t, i


def initiators(letters: DataFrame) -> DataFrame:
    """(chain, letter, confidence): the latest internal author who is no analyst, else the latest of unknown address, else the latest external one.

    ``letters`` has chain, letter, sender_key, sent_at, origin and role; a
    letter that comes as file and as quote counts once.
    """
    minute = F.coalesce(F.date_format("sent_at", "yyyy-MM-dd HH:mm"), F.concat(F.lit("#"), F.col("letter").cast("string")))
    once = registry.first_of(letters.withColumn("__m", minute), ["chain", "sender_key", "__m"], [F.col("origin") == "quoted", F.col("letter")])
    rank = F.array_position(F.array(*map(F.lit, ROLES_FIRST)), F.col("role"))
    order = F.struct(-rank, F.col("sent_at").isNotNull(), "sent_at", F.col("letter"))
    best = once.where(rank > 0).groupBy("chain").agg(F.max_by(F.struct("letter", "role"), order).alias("b"))
    out = once.select("chain").distinct().join(best, "chain", "left")
    confidence = F.when(F.col("b.role") == "internal", F.lit("high")).when(F.col("b.role").isNotNull(), F.lit("low")).otherwise(F.lit("none"))
    return out.select("chain", F.col("b.letter").alias("letter"), confidence.alias("confidence"))


def scrub(value: Column, names: Sequence[str], analysts: Sequence[str] = ()) -> Column:
    """Text without personal data: names and their parts of three letters and more become roles, addresses and phones are masked."""
    out = F.coalesce(value, F.lit(""))
    for name in names:
        parts = sorted({p.strip(" .,") for p in (name, *name.split()) if len(p.strip(" .,")) >= 3}, key=lambda p: (-len(p), p))
        if parts:
            choice = "|".join("\\Q" + p.replace("\\E", "") + "\\E" for p in parts)
            out = F.regexp_replace(out, rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{choice})(?![\p{{L}}\p{{N}}_])", "аналитик" if name in analysts else "пользователь")
    out = F.regexp_replace(out, r"(?U)\b(пользователь|аналитик)(?:\s+\1)+\b", "$1")
    for role in ("пользователь", "аналитик"):
        out = F.regexp_replace(out, rf"(?U)(^|[.!?]\s+|\n){role}\b", "$1" + role.capitalize())
    return text.mask_pii(out)


def article(issues: DataFrame, names: Sequence[str] = (), analysts: Sequence[str] = ()) -> DataFrame:
    """(id, title, text) of knowledge articles for issues with a resolution: symptom, cause, solution, links, without personal data.

    ``issues`` has title, category, description, error_text, actual,
    root_cause, resolution, objects, resolved_at and contact_name.
    """
    clean = lambda c, n=3000: F.left(F.trim(scrub(F.col(c), [*names, *analysts], analysts)), F.lit(n))
    facts = issues.where(F.trim(F.coalesce("resolution", F.lit(""))) != "").select(
        "id", "category", "objects", "resolved_at", clean("title", 150).alias("title"), clean("description").alias("description"),
        clean("error_text", 1500).alias("error_text"), clean("actual").alias("actual"), clean("root_cause").alias("cause"), clean("resolution").alias("solution"),
    )
    greeting = r"(?iu)^\s*(?:добрый (?:день|вечер)|доброе утро|здравствуйте|коллеги|привет)[^\n.!]*[.!,]?\s*"
    told = F.trim(F.regexp_replace(F.regexp_replace("description", greeting, ""), r"^\s*[А-ЯЁA-Z][а-яёa-z]+,\s*\n", ""))
    symptom = F.coalesce(F.nullif(F.left(told, F.lit(800)), F.lit("")), F.col("error_text"))
    symptom = F.concat(symptom, F.when(F.col("actual") != "", F.concat(F.lit("\nПолучено: "), "actual")).otherwise(F.lit("")))
    meta = F.concat_ws(
        " · ",
        F.concat(F.lit("Категория: "), F.nullif("category", F.lit(""))),
        F.when(F.size("objects") > 0, F.concat(F.lit("Объекты: "), F.array_join("objects", ", "))),
        F.concat(F.lit("Решено: "), F.date_format("resolved_at", "yyyy-MM-dd")),
    )
    blank = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    body = facts.withColumn("symptom", F.trim(symptom)).withColumn("meta", meta)
    unseen = (F.col("error_text") != "") & ~F.contains(F.col("symptom"), F.col("error_text"))
    lines = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Решённое обращение "), text.issue_number(F.col("id")), F.lit(": "), "title"),
        F.nullif("meta", F.lit("")),
        F.lit("## Симптом"),
        blank(F.col("symptom"), "—"),
        F.when(unseen, F.concat(F.lit("Текст ошибки:\n\n"), "error_text")),
        F.lit("## Причина"),
        blank(F.col("cause"), "Причина не указана."),
        F.lit("## Решение"),
        blank(F.col("solution"), "—"),
        F.when(F.size("objects") > 0, F.concat(F.lit("Ключевые слова: "), F.array_join(F.array_distinct("objects"), ", "))),
    )
    return body.select("id", "title", lines.alias("text"))


def publish(materials: DataFrame, articles: DataFrame, least: int = 40) -> DataFrame:
    """Materials to append (name, sha256, size, status) for articles that are long enough and not there yet."""
    fit = articles.where(F.length(F.trim("text")) >= least)
    rows = fit.select(text.safe_filename(F.concat("title", F.lit(".md"))).alias("name"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), F.lit("queued").alias("status"))
    return registry.append_new(materials.select("sha256"), rows, ["sha256"], [F.col("name")])


def title_of(value: Column, most: int = 120) -> Column:
    """Title of a message: its first sentence of eight characters and more after the greeting."""
    greeting = r"(?iu)^\s*(?:добрый (?:день|вечер)|доброе утро|здравствуйте|коллеги|привет)[^\n.!]*[.!,]?\s*"
    flat = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), greeting, "")), r"(?U)[ \t]+", " ")
    long_enough = F.filter(F.split(flat, r"(?<=[.!?])\s+|\n+"), lambda s: F.length(F.trim(s)) >= 8)
    return F.left(F.rtrim(F.coalesce(F.get(long_enough, F.lit(0)), flat), F.lit(" .")), F.lit(most))
