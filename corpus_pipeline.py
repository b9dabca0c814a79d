"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``. An empty
table goes through every stage and gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomkb.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from loomkb.session import table
from loomkb.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go.

    Null and empty texts are scored like any without known terms and stay
    unless most labelled texts are toxic; without labels all rows stay.
    Repeated rows share their fate. Extra columns come along.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, in one row.

    Null counts as empty, so of all null and empty texts one row stays. A null
    id loses against any other; an id with several texts keeps each of them
    that no larger id has. Extra columns come along.
    """
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by similarity 0.8 on five-word shingles, the smallest id stays.

    Texts without words, null texts and null ids hang together with nothing
    and stay. Rows of one id stay or go together. Extra columns come along.
    """
    return ngram_join.keep_one_of_each(docs, n=5, threshold=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them, at most three times.

    Null text is size 0 and null source a source of its own. Equal rows are
    documents of their own. Extra columns come along.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; every row of ``docs`` is a document of its own, null texts are empty."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Scores of a fitted model, entropy balancing and tokenizers are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
