"""URL filters: a trie over reversed host labels, then path segments.

The trie is built once from the rules, broadcast, and walked once per URL. The
rules are an argument of the caller, not data: more than ``MAX_RULE_BYTES`` of
them are refused, which bounds the broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import column

MAX_RULE_BYTES = 64 * 1024 * 1024
SCHEMA = "id long, host string, path string, rule string, verdict string"
_ASCII_LOWER = {code: code + 32 for code in range(65, 91)}


class Rule(NamedTuple):
    """``action`` is allow or block; ``path`` starts with a slash."""

    action: str
    host: str
    path: str


class _Node:
    """Children by host label or path segment; the rules that end here."""

    __slots__ = ("children", "paths", "rules")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.rules: list[tuple[str, Rule]] = []


def build_trie(rules: Sequence[Rule]) -> _Node:
    """The trie of ``rules``; a path's text after its last slash stays with its node."""
    if sum(len(rule.host) + len(rule.path) for rule in rules) > MAX_RULE_BYTES:
        raise ValueError(f"the rules hold over {MAX_RULE_BYTES} characters")
    root = _Node()
    for rule in rules:
        if rule.action not in ("allow", "block") or not rule.path.startswith("/"):
            raise ValueError(f"not a rule: {rule}")
        node = root
        for label in reversed(rule.host.translate(_ASCII_LOWER).split(".")):
            node = node.children.setdefault(label, _Node())
        node.paths = node.paths or _Node()
        node = node.paths
        *segments, rest = rule.path.split("/")
        for segment in segments:
            node = node.children.setdefault(segment, _Node())
        node.rules.append((rest, rule))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((at for at in map(rest.find, "?#") if at >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_ASCII_LOWER), slash + path


def judge(trie: _Node, host: str, path: str) -> Rule | None:
    """The longest rule that fits; of equal ones the longer host, then block."""
    best: tuple[int, int, bool] = (-1, -1, False)
    found = None
    pieces = path.split("/")
    node: _Node | None = trie
    for label in reversed(host.split(".")):
        node = node.children.get(label)
        if node is None:
            break
        below = node.paths
        for depth, piece in enumerate(pieces):
            if below is None:
                break
            if below.rules:
                left = "/".join(pieces[depth:])
                for rest, rule in below.rules:
                    rank = (len(rule.host) + len(rule.path), len(rule.host), rule.action == "block")
                    if rank > best and left.startswith(rest):
                        best, found = rank, rule
            below = below.children.get(piece) if depth < len(pieces) - 1 else None
    return found


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per input row: id, host, path, the rule that decided, and the verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest wins, and a URL that no rule fits takes ``default``. A
    null or broken URL has an empty host and path and so fits no rule. Repeated
    rows are judged each for itself; an empty table gives an empty result. Only
    the two named columns are read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(url) for url in batch.column("url").to_pylist()]
            found = [judge(trie, host, path) for host, path in parts]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"),
                pa.array([host for host, _ in parts], pa.string()),
                pa.array([path for _, path in parts], pa.string()),
                pa.array([rule and rule.host + rule.path for rule in found], pa.string()),
                pa.array([rule.action if rule else default for rule in found], pa.string()),
            ], names=["id", "host", "path", "rule", "verdict"])

    source = pages.select(column(id_column).cast("long").alias("id"),
                          column(url_column).cast("string").alias("url"))
    return source.mapInArrow(judged, SCHEMA)
