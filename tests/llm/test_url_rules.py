"""URL rules against brute force."""

import random

import pytest

from tidemark.llm.query_urls import RULES
from tidemark.llm.url_rules import Rule, build_trie, filter_urls, split_url


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = rest.split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.action == "block"))
    return host, path, best.host + best.path, best.action


URLS = [None, "", "example.com/en/", "http://", "http:///en/x", "https://Example.COM/en/1?x#y", "http://www.example.com/en/",
        "http://a.www.example.com/en/z", "http://example.com/en", "http://example.com", "http://notexample.com/en/",
        "http://x.net/es/", "http://net/fr/q", "http://x.net/fr?/fr/", "http://x.net#/fr/", "http://x.org/en/",
        "http://a..com/", "http://com./", "http://É.com/en/", "ftp://x.com://y/en/", "http://x.net//fr/", "HTTP://X.NET/ES/"]


def test_rows(spark):
    rows = list(enumerate(URLS)) + [(3, "http://x.com/"), (3, "http://x.com/"), (None, "http://x.net/fr/")]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = [tuple(r) for r in filter_urls(df, RULES).select("id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted(((i, *plain(u, RULES)) for i, u in rows), key=str)
    assert filter_urls(df.limit(0), RULES).collect() == []


def test_random_rules(spark):
    rng = random.Random(4)
    labels, parts = ["a", "b", "com"], ["", "x", "y", "xy"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(parts) for _ in range(rng.randrange(0, 4)))
    rules = [Rule(rng.choice(["allow", "block"]), host(), path()) for _ in range(60)]
    urls = [f"http://{host()}{path()}" for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, rules, default="block").collect()}
    assert got == {i: plain(u, rules, "block") for i, u in enumerate(urls)}


def test_refused():
    for rule in (Rule("deny", "a", "/"), Rule("allow", "a", "x")):
        with pytest.raises(ValueError):
            build_trie([rule])
    assert split_url("http://a/b#c?d") == ("a", "/b")
