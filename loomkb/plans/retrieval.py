"""Full-text retrieval over ``documents``, and names in them. Stems and occurrences at every place are beyond SQL; tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkb.operators import fulltext, names
from loomkb.operators.retrieval import fuse_ranks, vector_topk
from loomkb.plans.search import PROBE_ID
from loomkb.session import table
from loomkb.storage import scratch_path

#: The question of the registered queries.
QUESTION = "the thor of tions und"


def _index(spark, sf_dir):
    path = scratch_path(spark, "fulltext")
    fulltext.write_index(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    return path


def fulltext_rank(spark, sf_dir):
    """Every document that has a lexeme of the question, with both ranks."""
    found = fulltext.find(spark, _index(spark, sf_dir), QUESTION)
    words = len(fulltext.query_lexemes(QUESTION))
    both = fulltext.ranked(found, words).withColumnRenamed("score", "any_score").join(fulltext.ranked(found, words, every=True).withColumnRenamed("score", "all_score"), "id", "left")
    return both.select(F.col("id").alias("doc_id"), F.round("any_score", 9).alias("any_score"), F.round("all_score", 9).alias("all_score"))


def fulltext_hybrid(spark, sf_dir):
    """The best ten by vector and by full text together."""
    e = table(spark, sf_dir, "embeddings")
    vec = vector_topk(e, "vec_id", "embedding", e.where(f"vec_id = {PROBE_ID}").select("embedding"))
    return fuse_ranks(vec, fulltext.search(spark, _index(spark, sf_dir), QUESTION), 10)


def name_mentions(spark, sf_dir):
    """Every place where a document names a benchmark item by the item's first three words."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name_id"), F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 3), " ").alias("name"))
    found = names.occurrences(table(spark, sf_dir, "documents"), items, inflect=False)
    return found.select(F.col("id").alias("doc_id"), F.col("name_id").alias("item_id"), "start", "said")


QUERIES = {"name_mentions": name_mentions, "fulltext_rank": fulltext_rank, "fulltext_hybrid": fulltext_hybrid}
ORACLES: dict[str, str] = {}
