"""Hybrid retrieval over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomkb.operators import retrieval
from loomkb.session import table

#: The probe of the registered queries: vector 0 and three query terms.
PROBE_ID, PROBE_TERMS = 0, ("the", "with", "tion")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    documents = table(spark, sf_dir, "documents")
    probe = embeddings.where(f"vec_id = {PROBE_ID}").select("embedding")
    vec = retrieval.vector_topk(embeddings, "vec_id", "embedding", probe)
    lex = retrieval.lexical_topk(documents, "doc_id", "text", PROBE_TERMS)
    return retrieval.fuse_ranks(vec, lex, k=10)


QUERIES = {"hybrid_rrf": hybrid_rrf}

_TERMS = "[" + ", ".join(f"'{t}'" for t in PROBE_TERMS) + "]"
_VEC = f"""
vec AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rnk, score FROM (
  SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE_ID}) q
  ORDER BY score DESC, id LIMIT 40))"""
_LEX = f"""
lex AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rnk, score FROM (
  SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
         lambda t: list_contains({_TERMS}, t))) AS score
  FROM documents ORDER BY score DESC, id LIMIT 40) WHERE score > 0)"""
ORACLES = {
    "hybrid_rrf": f"""WITH {_VEC}, {_LEX}
SELECT id, round(sum(1.0/(60+rnk)), 9) AS score, min(rnk) FILTER (WHERE src='vec') AS vec_rank,
       min(rnk) FILTER (WHERE src='lex') AS lex_rank
FROM (SELECT id, rnk, 'vec' AS src FROM vec UNION ALL SELECT id, rnk, 'lex' FROM lex)
GROUP BY id ORDER BY score DESC, id LIMIT 10""",
}
