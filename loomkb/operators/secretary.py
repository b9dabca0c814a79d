"""The assistant's registers: sessions, places, books, planned events, settings.

Commands come as rows (person, at, ...); each operator returns the state after
them, or the rows to append.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkb.operators import joins, registry


def stop_sessions(sessions: DataFrame, stops: DataFrame) -> DataFrame:
    """``sessions`` (person, status, started_at, finished_at, ...) where a running one ends as stopped at its person's first stop after its start."""
    running = sessions.where("status = 'running'")
    first = running.select("person", "started_at").join(stops.select("person", F.col("at").alias("__at")), "person").where("__at >= started_at")
    first = first.groupBy("person", "started_at").agg(F.min("__at").alias("__at"))
    out = sessions.join(first, ["person", "started_at"], "left")
    hit = (F.col("status") == "running") & F.col("__at").isNotNull()
    out = out.withColumn("finished_at", F.when(hit, F.col("__at")).otherwise(F.col("finished_at"))).withColumn("status", F.when(hit, "stopped").otherwise(F.col("status")))
    return out.select(*sessions.columns)


def session_ends(starts: DataFrame, tz: str = "tz") -> DataFrame:
    """``starts`` (at, minutes, until) with ends_at and minutes: an end named as HH:mm is local time, one that has passed is an error."""
    local = F.from_utc_timestamp("at", F.col(tz))
    end_local = F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd "), "until"), "yyyy-MM-dd HH:mm")
    left = F.greatest(F.lit(1), F.round((F.unix_timestamp(end_local) - F.unix_timestamp(local)) / 60).cast("int"))
    past = F.col("until").isNotNull() & (end_local <= local)
    minutes = F.when(past, F.lit(None)).when(F.col("until").isNotNull(), left).otherwise(F.col("minutes")).cast("int")
    out = starts.withColumn("error", F.when(past, "past").when(minutes.isNull(), "no length")).withColumn("minutes", minutes)
    return out.withColumn("ends_at", F.timestamp_seconds(F.unix_timestamp("at") + F.col("minutes") * 60))


def session_status(sessions: DataFrame, now: Column) -> DataFrame:
    """(person, minutes_left, minutes_passed) of running sessions; what is left is rounded up."""
    left = F.greatest(F.lit(0), F.unix_timestamp("ends_at") - F.unix_timestamp(now))
    passed = F.floor((F.unix_timestamp(now) - F.unix_timestamp("started_at")) / 60)
    return sessions.where("status = 'running'").select("person", F.ceil(left / 60).cast("long").alias("minutes_left"), passed.cast("long").alias("minutes_passed"))


def plan_events(planned: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("person", "place", "body", "kind", "local_day")) -> DataFrame:
    """State of planned events after planning again: new ones wait, skipped ones wait again with the new values, all others stay."""
    new = registry.first_of(incoming, keys, [F.col("at")])
    both = planned.alias("o").join(new.alias("n"), on=[F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], how="full")
    known, again = F.col("o.status").isNotNull(), F.col("o.status") == "skipped"
    given = F.col("n.at").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        if c == "status":
            return F.when(~known | again & given, F.lit("pending")).otherwise(F.col("o.status"))
        return F.when(known & ~(again & given), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return both.select(*[value(c).alias(c) for c in planned.columns])


def moves(places: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append for moves (person, at, city, tz, on_date): a later day starts at midnight of the zone the person is in now.

    A move to the city where the person is already changes nothing.
    """
    here = joins.as_of_join(incoming.withColumnRenamed("city", "to_city").withColumnRenamed("tz", "to_tz"), places, ["person"], "at", "effective_at", ["city", "tz"], slices=F.to_date)
    local_day = F.to_date(F.from_utc_timestamp("at", F.coalesce("tz", F.lit("UTC"))))
    later = F.coalesce(F.col("on_date") > local_day, F.lit(False))
    start = F.when(later, F.to_utc_timestamp(F.col("on_date").cast("timestamp"), F.coalesce("tz", F.lit("UTC")))).otherwise(F.col("at"))
    changed = here.where(later | ~F.col("city").eqNullSafe(F.col("to_city")))
    return changed.select("person", F.col("to_city").alias("city"), F.col("to_tz").alias("tz"), start.alias("effective_at"))


def page_marks(log: DataFrame, books: DataFrame) -> DataFrame:
    """Page marks with the pages read since the mark before and the share of the book."""
    w = Window.partitionBy("book").orderBy("at", "id")
    out = log.withColumn("delta", F.col("page") - F.lag("page").over(w)).join(books.select(F.col("id").alias("book"), "total_pages"), "book", "left")
    return out.withColumn("percent", F.round(F.least(F.col("page") / F.col("total_pages"), F.lit(1.0)) * 100).cast("int"))


def section_at(marks: DataFrame, toc: DataFrame) -> DataFrame:
    """``marks`` with the section of the table of contents that holds their page: the last one that begins at or before it."""
    return joins.as_of_join(marks, toc, ["book"], "page", "page", ["title"], tie="entry", slices=lambda page: F.floor(page / 100)).withColumnRenamed("title", "section")


def find_book(books: DataFrame, number: int | None = None, title: str | None = None) -> DataFrame:
    """The book of that number, else those whose title has a word beginning like the one given, else the only one being read."""
    if number is not None:
        return books.where(F.col("num") == number)
    if title:
        from loomkb.functions import text

        return books.where(F.arrays_overlap(text.title_stems(F.col("title")), text.title_stems(F.lit(title))))
    active = books.where("status = 'reading'")
    return active.where(F.lit(active.limit(2).count() == 1))


def books_table(books: DataFrame, log: DataFrame, toc: DataFrame) -> DataFrame:
    """Books with their last page, section, local time of the last mark and number of entries in the table of contents."""
    last = log.groupBy("book").agg(F.max_by(F.struct("page", "at", "tz"), F.struct("at", "id")).alias("m"))
    marks = last.select("book", F.col("m.page").alias("page"), F.col("m.at").alias("at"), F.col("m.tz").alias("tz"))
    placed = section_at(marks, toc)
    counts = toc.groupBy("book").agg(F.count(F.lit(1)).alias("toc_count"))
    out = books.withColumnRenamed("id", "book").join(placed, "book", "left").join(counts, "book", "left").fillna(0, ["toc_count"])
    return out.withColumn("last_text", F.date_format(F.from_utc_timestamp("at", F.coalesce("tz", F.lit("UTC"))), "dd.MM.yyyy HH:mm"))


def upsert_toc(toc: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, counts of added and updated by book) after entries (book, title, page, entry): a title that is there gets the new page."""
    new = entries.groupBy("book", "title").agg(F.max_by("page", "entry").alias("page"), F.max("entry").alias("entry"))
    known = toc.select("book", "title").withColumn("__known", F.lit(True))
    marked = new.join(known, ["book", "title"], "left")
    counts = marked.groupBy("book").agg(F.count_if(F.col("__known").isNull()).alias("added"), F.count_if(F.col("__known").isNotNull()).alias("updated"))
    return registry.merge(toc, new.select(*toc.columns), ["book", "title"], update=["page"]), counts


def delete_latest(log: DataFrame, book: int, page: int | None = None) -> DataFrame:
    """``log`` without the latest mark of a book, or without its latest mark at that page."""
    mine = (F.col("book") == book) & (F.lit(True) if page is None else F.col("page") == page)
    gone = log.where(mine).groupBy().agg(F.max_by("id", F.struct("at", "id")).alias("id")).where("id IS NOT NULL")
    return log.join(gone, "id", "left_anti").select(*log.columns)


def put_settings(settings: DataFrame, changes: DataFrame, fields: Sequence[str] = ("astro", "planets", "stars")) -> DataFrame:
    """State of switches by person after changes (null: as it is); switches nobody touched are on."""
    out = settings.select("person", *fields).join(changes.select("person", *[F.col(f).alias(f"__{f}") for f in fields]), "person", "full")
    return out.select("person", *[F.coalesce(f"__{f}", f, F.lit(True)).alias(f) for f in fields])


def state(persons: DataFrame, sessions: DataFrame, places: DataFrame, books: DataFrame, now: Column) -> DataFrame:
    """One row for each person: place now, minutes left of the running session, books being read."""
    here = joins.as_of_join(persons.select("person", now.alias("now")), places, ["person"], "now", "effective_at", ["city", "tz"])
    running = session_status(sessions, now).select("person", "minutes_left")
    reading = books.where("status = 'reading'").groupBy("person").agg(F.array_sort(F.collect_list("title")).alias("reading"))
    return here.join(running, "person", "left").join(reading, "person", "left").drop("now")


def weather_text(temperature: Column, feels: Column, condition: Column, wind: Column, humidity: Column) -> Column:
    """What is known of the weather in one line; how it feels only where that differs."""
    signed = lambda x: F.format_string("%+d", F.round(x).cast("int"))
    return F.concat_ws(
        ", ",
        F.when(temperature.isNotNull(), F.concat(signed(temperature), F.lit(" °C"))),
        F.when(feels.isNotNull() & ~F.round(feels).eqNullSafe(F.round(temperature)), F.concat(F.lit("ощущается как "), signed(feels))),
        F.nullif(F.lower(F.regexp_replace(F.trim(condition), r"\.$", "")), F.lit("")),
        F.when(wind.isNotNull(), F.concat(F.lit("ветер "), F.round(wind).cast("int").cast("string"), F.lit(" м/с"))),
        F.when(humidity.isNotNull(), F.concat(F.lit("влажность "), humidity.cast("string"), F.lit(" %"))),
    )


def country_zones(zones: DataFrame) -> DataFrame:
    """(country, zones) of a zone table with columns codes, place and zone: the first of a country is its main one."""
    rows = zones.withColumn("country", F.explode(F.split("codes", ",")))
    return rows.groupBy("country").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "zone"))), lambda r: r["zone"]).alias("zones"))
