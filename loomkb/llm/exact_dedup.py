"""Exact duplicates by 128-bit content hash, checked byte by byte.

Plan, all DataFrame expressions:

1. one pass hashes the normalised text to 128 bits (and SHA-256 for the report);
2. partial aggregation by hash counts groups before anything is shuffled, so a
   group that holds a third of all rows travels as one row per task;
3. only texts of groups with two or more rows are grouped again on their bytes;
   two texts that collide in the 128-bit hash fall apart there. A Bloom filter
   of the hashes of such groups, of bounded size, keeps most other texts out of
   the shuffle;
4. decisions are joined back on the hash, a plain sort-merge join that
   adaptive execution can split where one hash is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.llm.bloom import build_level
from loomkb.session import table
from loomkb.storage import materialize

#: Words of the filter of repeated hashes at most: 8 MB.
FILTER_WORDS = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Null counts as empty; only the letters A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One decision row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names which id of a group stays: ``"max"`` or ``"min"``. Texts are
    equal when their normalised bytes are equal. Null texts equal empty ones.
    Null ids lose against any other id; a group of null ids only keeps null.
    Repeated rows of one id count each in group_size and share their decision.
    An empty table gives an empty result; other columns are not looked at.
    """
    best = F.max if keep == "max" else F.min
    text = normalised(F.col(text_col))
    hashed = materialize(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("__t")).select(
            "doc_id", F.unhex(F.md5("__t")).alias("h"), F.sha2("__t", 256).alias("text_sha256")
        ),
        "hashes",
    )
    groups = materialize(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("keep_id")), "groups")
    repeated = groups.where("n > 1").select(F.col("h").alias("key"))
    maybe = build_level(repeated, 0, 1, FILTER_WORDS)
    # equal texts are counted before they are shuffled; a generator's result is computed once, whatever tests it
    hash_once = F.explode(F.array(F.unhex(F.md5(normalised(F.col(text_col)))))).alias("__h")
    same_bytes = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"), hash_once)
        .where(maybe.holds(F.col("__h")))
        .select("doc_id", normalised(F.col("__t")).alias("t"))
        .groupBy("t")
        .agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("keep_id"))
        .where("n > 1")
        .select(F.unhex(F.md5("t")).alias("h"), F.sha2("t", 256).alias("text_sha256"), "n", "keep_id")
    )
    confirmed = materialize(same_bytes, "confirmed")
    found = hashed.join(confirmed, ["h", "text_sha256"], "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns: the one whose id stays.

    An id may carry several texts, each is decided by itself. Of several rows
    with the id that stays, the first in the order of all columns stays. Nulls
    and empty tables as in ``exact_dedup``.
    """
    decided = exact_dedup(docs, id_col, text_col, keep).where("kept")
    kept = decided.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("__n"))
    kept = materialize(kept, "kept")
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.sha2(normalised(docs[text_col]), 256) == F.col("__sha"))
    single = docs.join(kept.where("__n = 1"), same, "left_semi")
    if not kept.where("__n > 1").take(1):
        return single
    rows = docs.join(kept.where("__n > 1"), same).groupBy("__id", "__sha")
    first = rows.agg(F.min(F.struct(*[docs[c].alias(c) for c in docs.columns])).alias("__row"))
    return single.unionByName(first.select("__row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
