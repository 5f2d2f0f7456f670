"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import periodic_runs as module
from tidemark.llm.periodic_runs import Words, _found, periodic_runs, runs_of, surviving
from tidemark.llm.query_runs import op11_periodic_runs, with_repeats


def plain_runs(words, least=24):
    """(start, length, period) of every run, by its definition."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(least, 3 * q):
                found.setdefault((at, end - at + q), q)
            at = max(end, at) + 1
    return sorted((start, size, q) for (start, size), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return [word for i, word in enumerate(words) if i not in gone]


def got(text, least=24):
    words = Words([text.encode()])
    return [(a, b - a, q) for a, b, q in runs_of(words, least).tolist()]


def made(rng):
    words = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(4)
        if kind == 0:
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        elif kind == 1:
            words += [str(rng.random()) for _ in range(rng.randrange(30))]
        else:
            size = rng.choice([1, 2, 3, 7, 8, 9, 25, 31, 32, 33, 40, 63, 64, 65, 90, 130])
            alphabet = [str(i) for i in range(rng.choice([1, 2, 3, 200]))]
            one = [rng.choice(alphabet) for _ in range(size)]
            many = rng.randrange(2, 6)
            long = (one * (many + 1))[:size * many + rng.randrange(size)]
            if kind == 3 and long:
                long[rng.randrange(len(long))] = "x"
            words += long
    return words


@pytest.mark.parametrize("seed", range(150))
def test_runs(seed):
    rng = random.Random(seed)
    words = made(rng)
    assert got(" ".join(words)) == plain_runs(words)
    assert got(" ".join(words), 6) == plain_runs(words, 6)


@pytest.mark.parametrize("seed", range(20))
def test_two_letters(seed):
    rng = random.Random(seed)
    words = [rng.choice("ab") for _ in range(400)]
    one, two = ["a"], ["a", "b"]
    while len(two) < 500:  # Fibonacci words are full of overlapping repeats
        one, two = two, two + one
    for text in (words, two[:400 + seed], ["a"] * (300 + seed), (["a"] * 40 + ["b"]) * (4 + seed)):
        assert got(" ".join(text)) == plain_runs(text)


def test_long_lags_do_not_grow_with_the_square():
    rng = random.Random(1)
    one = [str(rng.randrange(2000)) for _ in range(60_000)]
    assert got(" ".join(one * 4 + one[:77])) == [(0, 240_077, 60_000)]
    assert got("a " * 300_000) == [(0, 300_000, 1)]
    block = (["a"] * 50 + ["b"]) * 3000
    runs = got(" ".join(block))
    assert (0, len(block), 51) in runs and len(runs) == 3001


def test_splitting_leaves_what_runs_need():
    text = ["x"] + ["a", "b", "c"] * 9 + ["y"] + ["a", "b"] * 5 + ["z", "z"]
    words = Words([" ".join(text).encode(), b"a a", " ".join("pq" * 20).encode()])
    left = surviving(words.numbers, words.text, words.n_numbers, 24)
    assert sorted(map(tuple, left.tolist())) == [(1, 28), (words.firsts[2], words.firsts[3])]


def test_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a b", "a " * 30, "A a " * 15, "é\x0bü\x0c" * 20, "a\x00b " * 25,
             " ".join(made(rng)), "x " * 200_000 + "end", "a b " * 24]
    rows = [(i, text, i) for i, text in enumerate(texts)] + [(4, "a " * 30, 7), (None, "b " * 24, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    found = {(r["id"], r["collapsed"]): r for r in periodic_runs(df).collect()}
    assert len(periodic_runs(df).collect()) == len(rows)
    for ident, text, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        if len(words) < 2000:
            runs = plain_runs(words)
        else:
            runs = [(0, 200_000, 1)]
        row = found[ident, " ".join(plain_collapsed(words, runs))]
        assert [tuple(one) for one in row["runs"]] == runs and row["n_words"] == len(words)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(none).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(df, least=2)


def plain_row(ident, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(ident).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if n < 3000 else None
    if runs is None:  # long texts: only numpy can compare all lags in time
        numbers = np.unique(np.array(words, object).astype(bytes), return_inverse=True)[1]
        runs = {}
        for q in range(1, n // 3 + 1):
            cut = np.flatnonzero(np.concatenate(([True], numbers[:-q] != numbers[q:], [True])))
            for at in np.flatnonzero(np.diff(cut) - 1 >= max(24, 3 * q) - q):
                runs.setdefault((int(cut[at]), int(cut[at + 1] - cut[at] - 1 + q)), q)
        runs = sorted((s, size, q) for (s, size), q in runs.items())
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(plain_collapsed(words, runs))).hexdigest())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_periodic_runs(spark, sf).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert tuple(row)[1:] == plain_row(row["doc_id"], docs[row["doc_id"]]), row["doc_id"]
    assert sum(row["n_runs"] > 0 for row in rows) > 5


def test_repeats_of_odd_rows(spark):
    picked = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    df = spark.createDataFrame(
        [(picked[0], None), (picked[1], " \n"), (picked[2], " a\tb\nc  d e f"), (None, "q r")],
        "doc_id long, text string")
    texts = {r["id"]: r["text"] for r in with_repeats(df).collect()}
    assert texts[picked[0]] is None and texts[picked[1]] == " \n"
    assert len(texts[picked[2]].split(" ")) == 6 and len(texts[None].split(" ")) == 2


def test_short_and_long_lags_meet():
    assert module.SHORT & (module.SHORT - 1) == 0
