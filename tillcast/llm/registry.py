"""The operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import (decontaminate, jaccard, language_model, manifest, mixing, negatives, neighbours, phrases, quality, substrings,
               token_counts, toxicity, urls)

QUERIES = {
    "op1_url_filter": urls.op1,
    "op2_token_counts": token_counts.op2,
    "op3_substring_dedup": substrings.op3,
    "op4_toxicity": toxicity.op4,
    "op5_quality_rules": quality.op5,
    "op6_benchmark_decontamination": decontaminate.op6,
    "op7_suffix_array_dedup": phrases.op7,
    "op8_ngram_jaccard_join": jaccard.op8,
    "op9_lm_scoring": language_model.op9,
    "op10_mix_sources": mixing.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_merkle_manifest": manifest.op12,
    "op13_nearest_neighbours": neighbours.op13,
}

ORACLE = {
    "op1_url_filter": urls.SQL,
    "op3_substring_dedup": substrings.SQL,
    "op6_benchmark_decontamination": decontaminate.SQL,
    "op7_suffix_array_dedup": phrases.SQL,
    "op8_ngram_jaccard_join": jaccard.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_merkle_manifest": manifest.SQL,
}
