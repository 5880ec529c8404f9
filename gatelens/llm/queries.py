"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from gatelens.llm import language_id, language_model, ngram_join, nn_descent, periodic_runs, phrase_index, quality_rank, quality_rules, secret_scan, source_mix, substring_dedup, token_alignment, toxicity

MODULES = (language_id, language_model, ngram_join, nn_descent, periodic_runs, phrase_index, quality_rank, quality_rules, secret_scan, source_mix, substring_dedup, token_alignment, toxicity)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
