"""Hybrid retrieval: vector and lexical top-k lists fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank constant of the fusion and candidates taken per list.
RRF_K, CANDIDATES = 60, 40


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays in double precision."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null when either has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    # the limit runs as TakeOrderedAndProject; only k rows are then numbered
    top = scored.orderBy(F.desc("score"), F.asc("id")).limit(k)
    numbered = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id")))
    return top.withColumn("rnk", numbered).select("id", "rnk", "score")


def vector_topk(vectors: DataFrame, id_col: str, vec_col: str, probe: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(id, rnk, score) of the ``k`` vectors nearest to the one-row ``probe``.

    Exact scan: one pass, one k-row merge; ties go to the smaller id. The probe
    is one row by contract and is the only thing broadcast.
    """
    one = probe.select(F.col(probe.columns[0]).alias("__probe")).limit(1)
    scored = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("__v")).join(F.broadcast(one))
    return _ranked(scored.select("id", F.round(cosine(F.col("__v"), F.col("__probe")), 9).alias("score")), k)


def tokens(text: Column) -> Column:
    """Lower-case word tokens (letters, digits, underscore of any script)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def lexical_topk(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str], k: int = CANDIDATES) -> DataFrame:
    """(id, rnk, score) by number of query-term occurrences; zero scores drop out."""
    wanted = F.array(*[F.lit(t) for t in terms])
    hits = F.size(F.filter(tokens(F.col(text_col)), lambda t: F.array_contains(wanted, t)))
    scored = docs.select(F.col(id_col).alias("id"), hits.cast("long").alias("score"))
    return _ranked(scored.where("score > 0"), k)


def fuse_ranks(vec: DataFrame, lex: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties go to the smaller id."""
    both = vec.select("id", "rnk", F.lit("vec").alias("src")).unionByName(
        lex.select("id", "rnk", F.lit("lex").alias("src"))
    )
    fused = both.groupBy("id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rnk"))), 9).alias("score"),
        F.min(F.when(F.col("src") == "vec", F.col("rnk"))).alias("vec_rank"),
        F.min(F.when(F.col("src") == "lex", F.col("rnk"))).alias("lex_rank"),
    )
    return fused.orderBy(F.desc("score"), F.asc("id")).limit(k)
