"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from revscope.llm import bpe, byte_bpe, jaccard, language_id, lm_score, media, packing, prefix_trie, sharding, suffix_dedup, token_files, topk, whitening

MODULES = [sharding, bpe, topk, token_files, jaccard, suffix_dedup, lm_score, media, language_id, packing, byte_bpe, prefix_trie, whitening]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
