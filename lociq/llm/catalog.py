"""All registered queries on texts, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, exact_dedup, language, mixing, ngram_join, packing, prefix_trie, quality, tokens, toxicity, urls, whitening

MODULES = [tokens, decontaminate, urls, exact_dedup, mixing, chat, toxicity, language, quality, ngram_join, packing, prefix_trie, whitening]
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
