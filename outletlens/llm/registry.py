"""The registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, lexical_search, lm_scoring, near_dedup, packing, pii, prefix_trie, quality, repeats, simhash, token_counts, url_filters

QUERIES = {
    "op3_suffix_array_dedup": repeats.op3_suffix_array_dedup,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_token_counts": token_counts.op2_token_counts,
    "op4_pii": pii.op4_pii,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_conversation_prefix_trie": prefix_trie.op11_conversation_prefix_trie,
    "op12_simhash_near_dedup": simhash.op12_simhash_near_dedup,
    "op13_ranked_lexical_search": lexical_search.op13_ranked_lexical_search,
}

ORACLE = {
    "op1_url_filters": url_filters.SQL,
    "op7_benchmark_decontamination": decontamination.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_conversation_prefix_trie": prefix_trie.SQL,
    "op13_ranked_lexical_search": lexical_search.SQL,
}
