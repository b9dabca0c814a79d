"""The registered queries of this subpackage."""

from __future__ import annotations

from loomkb.llm import embedding_dedup, exact_dedup, fill_middle, html_extract, line_dedup, mixing, ngram_join, packing, token_alignment, token_shards, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_html_extract": html_extract.op2_html_extract,
        "op3_warc_roundtrip": warc.op3_warc_roundtrip,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_token_shards": token_shards.op5_token_shards,
        "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_pack_sequences": packing.op9_pack_sequences,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict:
    return {
        "op3_warc_roundtrip": warc.OP3_SQL,
        "op4_embedding_dedup": embedding_dedup.OP4_SQL,
        "op6_ngram_jaccard": ngram_join.OP6_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op11_line_dedup": line_dedup.OP11_SQL,
        "op13_fill_middle": fill_middle.OP13_SQL,
    }
