"""Letters and threads: which letters are known, where they belong, what is new.

Letters come as (letter, sender_key, sent_at, body, message_id, subject, thread, position);
``stored`` rows have the same columns and a thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkb.functions import text
from loomkb.operators import joins
from loomkb.operators.components import connected_components
from loomkb.storage import materialize

# Time window of a quoted letter, likeness that makes it known, days that a subject stays alive.
WINDOW_SECONDS, STRONG, WEAK, SUBJECT_DAYS = 14 * 3600, 0.4, 0.75, 90
LEAD, SUMMARY_INPUT = 300, 24_000


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller shingle set that both have; 0 where one is empty."""
    return F.coalesce(text.overlap(a, b), F.lit(0.0))


def known_letters(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(letter, known, score): the stored letter that each incoming one repeats, null where it is new.

    A Message-ID decides where it is found. Otherwise letters of one sender
    within fourteen hours, or of unknown time, are compared by three-word
    shingles: 0.4 of the smaller is enough in the same minute of some time
    zone, 0.75 else; the best one wins, then the lowest. Letters whose
    Message-IDs differ are different. Rows meet by sender and time bucket, and
    only those close in time are compared.
    """
    def described(rows: DataFrame, side: str) -> DataFrame:
        named = [F.col(c).alias(f"{side}_{c}") for c in ("letter", "sender_key", "sent_at", "message_id")]
        return materialize(rows.select(*named, text.bind(text.words(F.col("body")), lambda w: text.shingles(w, 3)).alias(f"{side}_s")), f"letters-{side}")

    new, old = described(incoming, "n"), described(stored, "o")
    by_id = new.join(old, F.col("n_message_id") == F.col("o_message_id")).select(
        F.col("n_letter").alias("letter"), F.col("o_letter").alias("known"), F.lit(2.0).alias("score")
    )
    far_apart = F.abs(F.unix_timestamp("n_sent_at") - F.unix_timestamp("o_sent_at")) > WINDOW_SECONDS
    bucket = lambda c: F.floor(F.unix_timestamp(c) / WINDOW_SECONDS)
    timed_new = new.where("n_sent_at IS NOT NULL").withColumn("b", F.explode(F.array(*[bucket("n_sent_at") + F.lit(i) for i in (-1, 0, 1)])))
    timed_old = old.where("o_sent_at IS NOT NULL").withColumn("b", bucket("o_sent_at"))
    same_sender = (F.col("n_sender_key") == F.col("o_sender_key")) & (F.col("n_sender_key") != "")
    in_time = timed_new.join(timed_old, same_sender & (timed_new["b"] == timed_old["b"]) & ~far_apart).drop("b")
    undated = new.join(old.where("o_sent_at IS NULL"), same_sender).unionByName(new.where("n_sent_at IS NULL").join(old.where("o_sent_at IS NOT NULL"), same_sender))
    differ = F.coalesce(F.col("n_message_id") != F.col("o_message_id"), F.lit(False))
    scored = in_time.unionByName(undated).where(~differ).withColumn("score", containment(F.col("n_s"), F.col("o_s")))
    needed = F.when(joins.same_minute(F.col("n_sent_at"), F.col("o_sent_at")), F.lit(STRONG)).otherwise(F.lit(WEAK))
    close = scored.where(F.col("score") >= needed).select(F.col("n_letter").alias("letter"), F.col("o_letter").alias("known"), "score")
    best = by_id.unionByName(close).groupBy("letter").agg(F.max_by(F.struct("known", "score"), F.struct("score", -F.col("known"))).alias("m"))
    found = incoming.select("letter").join(best, "letter", "left")
    return found.select("letter", F.col("m.known").alias("known"), F.round(F.least(F.col("m.score"), F.lit(1.0)), 9).alias("score"))


def thread_by_subject(chains: DataFrame, letters: DataFrame, threads: DataFrame) -> DataFrame:
    """(chain, thread): the latest thread of the chain's subject that is alive and shares a sender; null where there is none.

    ``chains`` has chain, subject, newest and senders; ``letters`` thread and
    sender_key; ``threads`` thread, subject and last_at (null: alive).
    """
    wanted = chains.select("chain", "newest", F.explode(F.array_distinct("senders")).alias("sender_key"), F.lower(text.thread_subject(F.col("subject"))).alias("s"))
    named = threads.select("thread", "last_at", F.lower("subject").alias("s"))
    met = wanted.where("s <> '' AND sender_key <> ''").join(named, "s").where(
        F.col("last_at").isNull() | (F.unix_timestamp("last_at") >= F.unix_timestamp("newest") - SUBJECT_DAYS * 86400)
    )
    shared = met.join(letters.select("thread", "sender_key").distinct(), ["thread", "sender_key"], "left_semi")
    order = F.struct(F.col("last_at").isNotNull(), "last_at", -F.col("thread"))
    best = shared.groupBy("chain").agg(F.max_by("thread", order).alias("thread"))
    return chains.select("chain").join(best, "chain", "left")


def place_chains(incoming: DataFrame, known: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((chain, thread, new_letters, known_letters), (thread, merged_into)): where chains of letters belong.

    A chain goes to the lowest thread of its known letters and merges the
    others into it; threads that several chains hold together merge as well. A
    chain of new letters only has no thread yet.
    """
    found = incoming.select("letter", "chain").join(known.select("letter", "known"), "letter")
    of_letter = found.join(stored.select(F.col("letter").alias("known"), "thread"), "known", "left")
    chains = of_letter.groupBy("chain").agg(
        F.min("thread").alias("first"), F.count_if(F.col("known").isNull()).alias("new_letters"), F.count("known").alias("known_letters")
    )
    edges = of_letter.where("thread IS NOT NULL").join(chains.select("chain", "first"), "chain").select(F.col("thread").alias("a"), F.col("first").alias("b")).distinct()
    merged = connected_components(edges).where("node <> component").select(F.col("node").alias("thread"), F.col("component").alias("merged_into"))
    merged = materialize(merged, "merged")
    placed = chains.join(merged, chains["first"] == merged["thread"], "left")
    return placed.select("chain", F.coalesce("merged_into", "first").alias("thread"), "new_letters", "known_letters"), merged


def merge_threads(threads: DataFrame, merged: DataFrame) -> DataFrame:
    """State of (thread, issue, contours) after merging: the lowest thread keeps its issue or takes the first one, contours unite."""
    keyed = threads.join(merged, "thread", "left").withColumn("keep", F.coalesce("merged_into", "thread"))
    own = F.struct(F.col("issue").isNull(), F.col("thread") != F.col("keep"), "thread")
    return keyed.groupBy(F.col("keep").alias("thread")).agg(
        F.min_by("issue", own).alias("issue"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("contours")))).alias("contours")
    )


def chain_links(letters: DataFrame) -> DataFrame:
    """``letters`` with parent: in a chain each letter answers the next older one."""
    return letters.withColumn("parent", F.lead("letter").over(Window.partitionBy("chain").orderBy("position")))


def thread_letters(letters: DataFrame, group: str = "thread") -> DataFrame:
    """(thread, letters): the letters of each thread in time order, undated first."""
    row = F.struct(F.col("sent_at").isNotNull(), "sent_at", "letter", "sender", "body")
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(r["letter"], r["sent_at"], r["sender"], r["body"]))
    return letters.groupBy(group).agg(rows.alias("letters"))


def lead(body: Column, limit: int = LEAD) -> Column:
    flat = F.trim(F.regexp_replace(body, r"(?U)\s+", " "))
    return text.bind(flat, lambda t: F.concat(F.substring(t, 1, limit), F.when(F.length(t) > limit, F.lit("…")).otherwise(F.lit(""))))


def thread_summaries(letters: DataFrame) -> DataFrame:
    """(thread, letters, first_at, last_at, problem, last, participants) by template: what the first and the last letter begin with."""
    order = F.struct(F.col("sent_at").isNotNull(), "sent_at", "letter")
    ends = letters.groupBy("thread").agg(
        F.count(F.lit(1)).alias("letters"),
        F.min("sent_at").alias("first_at"),
        F.max("sent_at").alias("last_at"),
        F.min_by(F.struct("letter", "sender", "body"), order).alias("f"),
        F.max_by(F.struct("letter", "sender", "body"), order).alias("l"),
        F.array_sort(F.collect_set("sender")).alias("senders"),
    )
    last = F.concat(F.coalesce("l.sender", F.lit("?")), F.lit(": "), lead(F.col("l.body")))
    return ends.select(
        "thread", "letters", "first_at", "last_at", lead(F.col("f.body")).alias("problem"),
        F.when(F.col("l.letter") != F.col("f.letter"), last).otherwise(F.lit("")).alias("last"),
        F.array_join("senders", ", ").alias("participants"),
    )


def summary_input(letters: DataFrame, limit: int = SUMMARY_INPUT) -> DataFrame:
    """(thread, input): all letters one after another; of too long a text the end is kept."""
    def shown(r: Column) -> Column:
        when = F.coalesce(F.date_format(r["sent_at"], "dd.MM.yyyy HH:mm"), F.lit("дата неизвестна"))
        return F.concat(F.lit("— "), F.coalesce(r["sender"], F.lit("?")), F.lit(", "), when, F.lit(":\n"), F.trim(r["body"]))

    joined = thread_letters(letters).select("thread", F.array_join(F.transform("letters", shown), "\n\n").alias("t"))
    return joined.select("thread", F.when(F.length("t") > limit, F.concat(F.lit("…\n"), F.right("t", F.lit(limit)))).otherwise(F.col("t")).alias("input"))


def stale_summaries(summaries: DataFrame, letters: DataFrame) -> DataFrame:
    """Threads whose summary was made from another number of letters, with the chunk that it leaves superseded."""
    now = letters.groupBy("thread").agg(F.count(F.lit(1)).alias("now"))
    return now.join(summaries, "thread", "left").where(~F.col("now").eqNullSafe(F.col("letters"))).select("thread", "now", F.col("chunk").alias("superseded"))


def find_thread(threads: DataFrame, ref: str) -> DataFrame:
    """The thread with that number, or the latest one whose title contains the text."""
    number = ref.strip()
    if number.isdigit():
        return threads.where(F.col("thread") == int(number))
    return threads.where(F.contains(F.lower("title"), F.lit(number.lower()))).orderBy(F.col("last_at").desc_nulls_last(), F.col("thread").desc()).limit(1)


def apply_contours(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """``rows`` (letters or summary chunks with a thread) that take the contours given for their thread."""
    given = changed.select("thread", F.col("contours").alias("__given"))
    return rows.join(given, "thread", "left").withColumn("contours", F.coalesce("__given", "contours")).drop("__given")
