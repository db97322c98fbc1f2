"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from quarry.llm import conversation_repair, decontamination, embedding_dedup, html_extraction, jaccard_join, merkle_manifest, mixing, pii, quality_rules, secrets, substring_dedup, token_counts, toxicity

_MODULES = (substring_dedup, decontamination, embedding_dedup, token_counts, secrets, jaccard_join, merkle_manifest, mixing, html_extraction, pii, toxicity, quality_rules, merkle_manifest, conversation_repair)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
