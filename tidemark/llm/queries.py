"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from tidemark.llm import (
    query_bpe,
    query_conversations,
    query_decontaminate,
    query_embeddings,
    query_identifiers,
    query_licences,
    query_lm,
    query_runs,
    query_simhash,
    query_token_counts,
    query_token_files,
    query_toxicity,
    query_urls,
)

GROUPS = (query_urls, query_bpe, query_decontaminate, query_simhash, query_toxicity,
          query_lm, query_token_files, query_embeddings, query_licences,
          query_token_counts, query_runs, query_conversations,
          query_identifiers)


def all_queries() -> dict:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
