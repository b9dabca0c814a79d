"""Full-text search with stems and a rank by cover density, over a positional inverted index.

The index is a table of postings (lexeme, id, positions) in folders by a hash of
the lexeme, sorted inside; a search reads the folders and row groups of its
lexemes and no text. Lexemes of very many documents spread over several files.

The rank is the sum over covers, the shortest stretches of a document that
satisfy the query: where any lexeme is enough, each occurrence is a cover; where
all are wanted, a cover counts its lexemes divided by one and the words between.
Each occurrence weighs 0.1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.functions.stemming import TOKEN, lexeme, lexemes
from loomkb.operators.retrieval import CANDIDATES, _ranked

#: Weight of an occurrence; folders of an index; tasks that write a folder, at least; rows taken from Arrow at a time.
WEIGHT, BUCKETS, SPREAD, ROWS = 0.1, 64, 4, 256
POSTINGS = "lexeme string, id long, positions array<int>"


def query_lexemes(text: str) -> list[str]:
    """Distinct lexemes of a query, in order."""
    return list(dict.fromkeys(found for _, found in lexemes(text)))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(lexeme, id, positions) of whole texts; several columns are read one after another. Null and empty texts have none."""
    text = F.concat_ws(" ", *text_cols)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield _listed(batch.slice(at, ROWS))

    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(listed, POSTINGS)


def _listed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of some texts. A token that they have is stemmed once."""
    tokens, counts = [], []
    for content in rows.column(1).to_pylist():
        tokens += (found := TOKEN.findall((content or "").lower()))
        counts.append(len(found))
    token = pa.array(tokens, pa.string()).dictionary_encode()
    stem = pa.array(map(lexeme, token.dictionary.to_pylist()), pa.string()).dictionary_encode()
    word = stem.indices.fill_null(-1).to_numpy()[token.indices.to_numpy()].astype("i8")
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(1, len(word) + 1) - np.repeat(np.cumsum(counts) - counts, counts)
    key = (row * len(stem.dictionary) + word)[word >= 0]
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[word >= 0][order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    row, word = np.divmod(key[first], max(len(stem.dictionary), 1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place, pa.int32()))
    return pa.RecordBatch.from_arrays([stem.dictionary.take(pa.array(word)), rows.column(0).take(pa.array(row)), lists], names=["lexeme", "id", "positions"])


def write_index(docs: DataFrame, path: str, id_col: str, *text_cols: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """Write postings below ``path``; with ``mode="append"`` documents are added to an index of as many folders."""
    # texts are read once: ranges would be found by reading them all before; a folder is dealt over tasks by ids
    tasks = max(SPREAD, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    rows = postings(docs, id_col, *text_cols).withColumns({"bucket": _bucket(buckets), "part": F.pmod(F.xxhash64("id"), F.lit(tasks))})
    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "lexeme", "id").drop("part")
    dealt.write.partitionBy("bucket").mode(mode).parquet(path)


def find(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """Postings of the query's lexemes; no file of other folders is read."""
    words = query_lexemes(query)
    index = spark.read.schema(f"{POSTINGS}, bucket int").parquet(path)
    if not words:
        return index.where("false").drop("bucket")
    # the folder numbers are computed by the engine, as when they were written
    wanted = spark.range(1).select(F.explode(F.lit(words)).alias("lexeme")).select(_bucket(buckets).alias("b"))
    folders = sorted({r["b"] for r in wanted.collect()})
    return index.where(F.col("bucket").isin(folders) & F.col("lexeme").isin(words)).drop("bucket")


def covers(lists: list[np.ndarray]) -> float:
    """Cover density of a document that has all lexemes, one list of positions each."""
    total, merged = 0.0, list(heapq.merge(*[[(int(p), i) for p in held] for i, held in enumerate(lists)]))
    last: dict[int, int] = {}
    begin = -1
    for at, (position, which) in enumerate(merged):
        last[which] = at
        if len(last) < len(lists):
            continue
        start = min(last.values())
        if start > begin:  # a shorter stretch than any that begins before
            begin = start
            inside = at - start + 1
            words_between = max(position - merged[start][0] - (inside - 1), 0)
            total += WEIGHT / (1 + words_between)
    return total


def ranked(found: DataFrame, words: int, every: bool = False) -> DataFrame:
    """(id, score) of all documents of ``find``'s postings, by any lexeme or by those that have all ``words`` of them."""
    if not every:
        return found.groupBy("id").agg((F.sum(F.size("positions")) * F.lit(WEIGHT)).alias("score"))

    @F.pandas_udf("double")
    def density(lists: pd.Series) -> pd.Series:
        return pd.Series([covers(list(x)) for x in lists], dtype="float64")

    whole = found.groupBy("id").agg(F.collect_list("positions").alias("lists")).where(F.size("lists") == words)
    return whole.select("id", density("lists").alias("score"))


def search(spark: SparkSession, path: str, query: str, every: bool = False, k: int = CANDIDATES, buckets: int = BUCKETS) -> DataFrame:
    """(id, rnk, score) of the best ``k`` documents; ties go to the smaller id."""
    scored = ranked(find(spark, path, query, buckets), len(query_lexemes(query)), every)
    return _ranked(scored.withColumn("score", F.round("score", 9)), k)
