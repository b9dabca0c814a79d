"""Mixing sources to target weights by entropy balancing.

The mix is the document rates closest in relative entropy to taking every
document once, among rates between 0 and ``MAX_COPIES``, that meet each
source's token target. The dual is convex with one multiplier per source, and
its solution tilts the rates exponentially in the document's size ``x``:

    rate = 3 e^(l x) / (2 + e^(l x))      (l = 0: every document once)

Newton steps run over a histogram of (source, size) that is aggregated once, so
an iteration reads distinct sizes and not documents. Rates become copies by
diffusing the rounding error inside small hash buckets, largest document first:
what a document takes too little or too much goes to the next smaller ones, so
the sum of a bucket ends within about one small document of its rates' sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkb.session import table
from loomkb.storage import materialize

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Documents per rounding bucket, on average.
BUCKET = 256
TOLERANCE, MAX_STEPS = 1e-7, 80


def word_count(text: Column) -> Column:
    """Number of words; space and the controls tab to carriage return separate them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``__rank`` from 0 by code point, null last.

    Ranges of sources are numbered apart, each after the sources of the ranges
    before it; the one window over everything sees a row for each range.
    """
    order = F.col("source").asc_nulls_last()
    ranges = materialize(sources.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return ranges.withColumn("__inside", inside).join(firsts, "__part").withColumn("__rank", F.col("__first") + F.col("__inside")).drop("__part", "__first", "__inside")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """``sources`` (source, source_size, ...) with the target of each.

    Sources sorted by code point, null last, take the weights in turn and share
    the sum of all sizes; a target stops at ``cap`` times its source's size and
    the excess is shared by weight among the others until none is above. Each
    round of sharing is one aggregation.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    t = ranked(sources).withColumn("__w", weight).withColumn("__cap", F.col("source_size") * float(cap))
    t = materialize(t.drop("__rank"), "weighted")
    whole = t.agg(F.sum("source_size").cast("double").alias("all"), F.sum("__w").alias("w")).first()
    level, full = (whole["all"] or 0.0) / (whole["w"] or 1.0), -1
    while True:
        at_cap = F.lit(level) * F.col("__w") >= F.col("__cap")
        r = t.agg(F.count_if(at_cap).alias("n"), F.sum(F.when(at_cap, F.col("__cap"))).alias("cap"), F.sum(F.when(~at_cap, F.col("__w"))).alias("w")).first()
        if r["n"] == full or not r["w"]:
            break
        # weights and caps are whole numbers, so their sums are exact
        level, full = (whole["all"] - (r["cap"] or 0.0)) / r["w"], r["n"]
    at_cap = F.lit(level) * F.col("__w") >= F.col("__cap")
    target = F.when(at_cap, F.col("__cap")).otherwise(F.lit(level) * F.col("__w"))
    return t.withColumns({"target": target, "full": at_cap}).drop("__w", "__cap")


def solve_tilts(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """Multiplier ``tilt`` per source by safeguarded Newton steps on the dual.

    ``histogram`` has (source, size, n), ``targets`` (source, target, scale,
    full). Each step is one aggregation of the histogram; sources at their cap
    need none. Targets that ``MAX_STEPS`` steps do not reach are an error.
    """
    no = F.lit(None).cast("double")
    state = targets.withColumns({"tilt": F.lit(0.0), "lo": no, "hi": no})
    for _ in range(MAX_STEPS):
        h, s = histogram.alias("h"), state.where("not full").alias("s")
        x = F.col("h.size") / F.col("s.scale")
        rate = tilted_rate(F.col("s.tilt"), x)
        tokens = F.col("h.n") * F.col("h.size") * rate
        sums = (
            h.join(s, F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("source"))
            .agg(exact_sum(tokens).alias("f"), exact_sum(tokens * x * (1 - rate / MAX_COPIES)).alias("d"))
        )
        joined = state.alias("s").join(sums.alias("u"), F.col("s.source").eqNullSafe(F.col("u.source")), "left")
        gap = F.coalesce(F.col("f") - F.col("s.target"), F.lit(0.0))
        lo = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), gap / F.greatest(F.col("d"), F.lit(1e-300))))
        outside = (step <= F.coalesce(lo, step - 1)) | (step >= F.coalesce(hi, step + 1))
        tilt = F.when(gap == 0, F.col("tilt")).when(outside, (lo + hi) / 2).otherwise(step)
        error = F.abs(gap) / F.greatest(F.col("s.target"), F.lit(1.0))
        kept = [F.col(f"s.{c}").alias(c) for c in targets.columns]
        state = materialize(joined.select(*kept, tilt.alias("tilt"), lo.alias("lo"), hi.alias("hi"), error.alias("error")), "tilts")
        worst = state.agg(F.max("error")).first()[0]
        state = state.drop("error")
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise ArithmeticError(f"after {MAX_STEPS} steps a source is {worst:.1e} of its target away from it")
    return state.select(*targets.columns, "tilt")


def exact_sum(x: Column) -> Column:
    """Sum that is the same in whatever order the rows come: a sum of decimals."""
    return F.sum(x.cast("decimal(38,8)")).cast("double")


def tilted_rate(tilt: Column, x: Column) -> Column:
    return F.lit(float(MAX_COPIES)) / (1 + (MAX_COPIES - 1) * F.exp(-tilt * x))


def sizes_and_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, same: Sequence[Column]) -> DataFrame:
    """(doc_id, size, source, h) of every row; ``h`` hashes the columns in which equal rows agree."""
    return docs.select(
        F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), F.xxhash64(*same).alias("h")
    )


def decide(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """How many copies each distinct row of ``sized`` gets: ``total`` for its ``n`` equal rows together, with rate, target and source size.

    Equal rows travel as one with a count, and buckets are hashes of id and
    row, so neither a repeated id nor a repeated row crowds a bucket: a bucket
    has about ``BUCKET`` rows whatever the input.
    """
    measured = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    tokens = (F.col("n") * F.col("size")).cast("decimal(20,0)")
    per_source = measured.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum("n").alias("docs"),
        (F.sum(tokens * F.col("size").cast("decimal(12,0)")).cast("double") / F.greatest(F.sum(tokens).cast("double"), F.lit(1.0))).alias("scale"),
    )
    per_source = per_source.withColumn("scale", F.greatest("scale", F.lit(1.0)))
    targets = materialize(source_targets(per_source, weights), "targets")
    tilts = materialize(solve_tilts(measured, targets), "rates")
    distinct = sized.groupBy("source", "doc_id", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    d, t = distinct.alias("d"), tilts.alias("t")
    rate = F.when(F.col("t.full"), F.lit(float(MAX_COPIES))).otherwise(tilted_rate(F.col("t.tilt"), F.col("d.size") / F.col("t.scale")))
    rated = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        F.col("d.source").alias("source"),
        F.pmod(F.xxhash64("d.doc_id", "d.h"), F.ceil(F.col("t.docs") / F.lit(BUCKET))).alias("bucket"),
        F.struct(
            (-F.col("d.size")).alias("order"),
            F.col("d.doc_id").alias("doc_id"),
            F.col("d.h").alias("h"),
            F.col("d.size").alias("size"),
            F.col("d.n").alias("n"),
            rate.alias("rate"),
            F.col("t.source_size").alias("source_size"),
            F.col("t.target").alias("target"),
        ).alias("doc"),
    )
    grouped = rated.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    # sums of rounding errors run along the sorted bucket
    start = F.struct(F.lit(0.0).alias("error"), F.array().cast("array<bigint>").alias("totals"))

    def place(done: Column, doc: Column) -> Column:
        # the number of copies that brings the bucket's sum nearest to what its rates ask for
        due = done["error"] + doc["rate"] * doc["size"] * doc["n"]
        nearest = F.ceil(due / F.greatest(doc["size"], F.lit(1)) - 0.5)
        few = F.when(doc["size"] == 0, F.floor(doc["rate"]) * doc["n"]).otherwise(nearest)
        k = F.greatest(F.lit(0), F.least(MAX_COPIES * doc["n"], few)).cast("long")
        return F.struct((due - k * doc["size"]).alias("error"), F.concat(done["totals"], F.array(k)).alias("totals"))

    totals = F.aggregate("docs", start, place)["totals"]
    out = grouped.select("source", F.explode(F.arrays_zip(F.col("docs").alias("doc"), totals.alias("total"))).alias("r"))
    return out.select("source", "r.doc.*", F.col("r.total").alias("total")).drop("order")


def repeated(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times with its number from 0, in two steps so that no array is long."""
    last = times.cast("long") - 1
    blocks = rows.where(times > 0).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(last, 10))))
    first = F.shiftleft("__block", 10)
    return blocks.withColumn(name, F.explode(F.sequence(first, F.least(first + 1023, last)))).drop("__block")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken for every row.

    Null text is size 0, null source is a source of its own, sorted last.
    Documents of size 0 are taken as often as their rate rounds down to and
    take no words. Repeated rows and ids are documents of their own, null ids
    too. Reruns give the same copies in whatever partitions the rows come:
    order and buckets depend on sizes, ids and texts only, and sums are exact.
    An empty table gives an empty result; other columns are not looked at.
    """
    decided = decide(sizes_and_keys(docs, id_col, text_col, source_col, [F.col(text_col)]), weights)
    rows = repeated(decided, F.col("n"), "__i")
    upto = lambda i: F.floor(i * F.col("total") / F.col("n"))
    copies = F.when(F.col("n") == 1, F.col("total")).otherwise(upto(F.col("__i") + 1) - upto(F.col("__i"))).cast("int")
    out = rows.select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"))
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The mix itself: every document as many times as it is taken, columns as in ``docs``.

    Copies are decided without the texts and joined back by id, source and a
    hash of the text. Rows that agree in these are counted by their other
    columns first, so a row that repeats very often meets its decision as one,
    and share their copies in the order of all columns.
    """
    decided = decide(sizes_and_keys(docs, id_col, text_col, source_col, [F.col(text_col)]), weights)
    names = {"doc_id": "__id", "source": "__source", "h": "__h", "n": "__n", "total": "__total"}
    decided = materialize(decided.select(*[F.col(c).alias(name) for c, name in names.items()]), "decided").where("__total > 0")
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    same = keyed["__key"].eqNullSafe(F.col("__h")) & keyed[id_col].eqNullSafe(F.col("__id")) & keyed[source_col].eqNullSafe(F.col("__source"))
    taken = keyed.join(decided.where("__n = 1"), same).select(*docs.columns, "__total")
    if decided.where("__n > 1").take(1):
        keys = ["__id", "__source", "__h", "__n", "__total"]
        rows = keyed.join(decided.where("__n > 1"), same).groupBy(*[keyed[c] for c in docs.columns], *keys).agg(F.count(F.lit(1)).alias("__rows"))
        end = F.sum("__rows").over(Window.partitionBy("__id", "__source", "__h").orderBy(*docs.columns).rowsBetween(Window.unboundedPreceding, 0))
        upto = lambda i: F.floor(i * F.col("__total") / F.col("__n"))
        share = upto(F.col("__end")) - upto(F.col("__end") - F.col("__rows"))
        taken = taken.unionByName(rows.withColumn("__end", end).select(*docs.columns, share.alias("__total")))
    return repeated(taken, F.col("__total"), "__i").select(*docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
