"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from logaudit.llm import decontamination, divergence, huffman, line_dedup, ngram_trie, packing, passage_dedup, quality_rules, resampling, secret_scan, sharding, simhash, warc

QUERIES = {
    "op1_secret_forest": secret_scan.query,
    "op2_elias_fano_bigrams": ngram_trie.query,
    "op3_hash_tree_sharding": sharding.query,
    "op4_simhash_pivots": simhash.query,
    "op5_deletion_neighbourhood_lines": line_dedup.query,
    "op6_huffman_token_files": huffman.query,
    "op7_paragraph_minhash": passage_dedup.query,
    "op8_tier_packing": packing.query,
    "op9_benchmark_decontamination": decontamination.query,
    "op10_quality_ledger": quality_rules.query,
    "op11_block_divergence": divergence.query,
    "op12_warc_archive": warc.query,
    "op13_bucket_resampling": resampling.query,
}

ORACLE_SQL = {
    "op3_hash_tree_sharding": sharding.SQL,
    "op9_benchmark_decontamination": decontamination.SQL,
    "op10_quality_ledger": quality_rules.SQL,
    "op11_block_divergence": divergence.SQL,
    "op12_warc_archive": warc.SQL,
    "op13_bucket_resampling": resampling.SQL,
}
