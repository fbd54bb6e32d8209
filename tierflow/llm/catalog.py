"""Queries of this subpackage: one per operator, with oracle SQL where SQL can express it."""

from __future__ import annotations

from . import byte_bpe, divergence, html_extract, importance, line_dedup, mixing, piecewise_hash, simhash, suffix_dedup, token_counts, topk, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_mixing": mixing.query,
    "op3_byte_bpe": byte_bpe.query,
    "op4_html_extraction": html_extract.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_token_counts": token_counts.query,
    "op7_piecewise_hash": piecewise_hash.query,
    "op8_url_filters": url_filter.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_exact_topk": topk.query,
    "op11_line_dedup": line_dedup.query,
    "op12_source_divergence": divergence.query,
    "op13_importance_resampling": importance.query,
}
ORACLE = {
    "op2_mixing": mixing.SQL,
    "op8_url_filters": url_filter.SQL,
    "op9_suffix_dedup": suffix_dedup.SQL,
    "op10_exact_topk": topk.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_importance_resampling": importance.SQL,
}
