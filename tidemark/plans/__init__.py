"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans import caching, documents, exchange, settings, sources, streams

GROUPS = (sources, caching, documents, settings, exchange, streams)


def all_queries() -> dict:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
