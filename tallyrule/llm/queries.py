"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bagminhash, exact, lines, media, mixing, pieces, quality, resample, sharding, spelling, substring, topk, urlrank

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_quality_pu": quality.query,
    "op3_substring_dedup": substring.query,
    "op4_shard_shuffle": sharding.query,
    "op5_exact_dedup": exact.query,
    "op6_line_dedup": lines.query,
    "op7_topk_search": topk.query,
    "op8_sentencepiece": pieces.query,
    "op9_near_dedup": bagminhash.query,
    "op10_url_filter": urlrank.query,
    "op11_spelling_variants": spelling.query,
    "op12_importance_sample": resample.query,
    "op13_media_columns": media.query,
}

ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op3_substring_dedup": substring.SQL,
    "op5_exact_dedup": exact.SQL,
    "op6_line_dedup": lines.SQL,
    "op7_topk_search": topk.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_importance_sample": resample.SQL,
    "op13_media_columns": media.SQL,
}
