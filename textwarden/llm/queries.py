"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from textwarden.llm import ann, bpe, decontaminate, merkle, near_dedup, pii, prefix_trie, quality, rollups, token_files, toxicity, url_filter, winnowing

QUERIES = {
    "op1_nearest": ann.op1_nearest,
    "op2_bpe_codec": bpe.op2_bpe_codec,
    "op3_pii": pii.op3_pii,
    "op4_token_files": token_files.op4_token_files,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_token_counts": rollups.op8_token_counts,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_fingerprints": winnowing.op12_fingerprints,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {
    "op1_nearest": ann.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
