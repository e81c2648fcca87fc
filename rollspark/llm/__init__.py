"""Operators for preparing language-model training data, one module each.

``queries()`` runs each operator over its whole table; ``oracle_sql()`` has the
DuckDB SQL of those that SQL can express. Nothing else in the library imports
this subpackage.
"""

from __future__ import annotations

from rollspark.llm import ann, decontam, html_text, jaccard_trie, langid, manifest, mixing_lm, packing, periodic, pseudonyms, shards, token_counts, url_lists


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_inverted_multi_index": ann.op3_inverted_multi_index,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_temporal_url_lists": url_lists.op5_temporal_url_lists,
        "op6_spaced_seed_overlaps": decontam.op6_spaced_seed_overlaps,
        "op7_html_main_text": html_text.op7_html_main_text,
        "op8_feistel_pseudonyms": pseudonyms.op8_feistel_pseudonyms,
        "op9_ngram_jaccard_join": jaccard_trie.op9_ngram_jaccard_join,
        "op10_context_mixing": mixing_lm.op10_context_mixing,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_stratified_shards": shards.op12_stratified_shards,
        "op13_merkle_manifest": manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict:
    return {
        "op5_temporal_url_lists": url_lists.ORACLE,
        "op9_ngram_jaccard_join": jaccard_trie.ORACLE,
        "op12_stratified_shards": shards.ORACLE,
        "op13_merkle_manifest": manifest.ORACLE,
    }
