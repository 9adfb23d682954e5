"""The subpackage's queries and their SQL, for registration."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, kdshards, line_templates, ngram_join, packing, pii, quality, spelling, token_counts, topk, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_kd_shards": kdshards.op3_kd_shards,
    "op4_warc": warc.op4_warc,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_top_k": topk.op6_top_k,
    "op7_packing": packing.op7_packing,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_line_templates": line_templates.op10_line_templates,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_pii": pii.op13_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": warc.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_top_k": topk.OP6_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op10_line_templates": line_templates.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
