"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from flowcast.llm import collocations, conversation_trie, jaccard_join, license_scan, line_join, packing, positional_index, quality, shards, stream_dedup, syncmers, token_files, toxicity

QUERIES = {
    "op1_positional_index": positional_index.query,
    "op2_simple8b_files": token_files.query,
    "op3_line_join": line_join.query,
    "op4_toxicity_kernel": toxicity.query,
    "op5_stream_dedup": stream_dedup.query,
    "op6_quality_ftrl": quality.query,
    "op7_range_shards": shards.query,
    "op8_license_scan": license_scan.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_best_fit_packing": packing.query,
    "op11_prefix_trie": conversation_trie.query,
    "op12_collocations": collocations.query,
    "op13_syncmer_prints": syncmers.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_positional_index": positional_index.SQL,
    "op5_stream_dedup": stream_dedup.SQL,
    "op11_prefix_trie": conversation_trie.SQL,
    "op12_collocations": collocations.SQL,
}
