"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tidemark.llm.components import components, spanning_edges
from tidemark.llm.simhash import SUBTREE, links, simhash_groups, walk_pairs


def plain_print(text, size=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", words) if w]
    runs = [words[i:i + size] for i in range(len(words) - size + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), 42) for run in runs]
    return sum(1 << bit for bit in range(64)
               if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget=2):
    label = dict(enumerate(range(len(prints))))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= budget and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_texts_against_all_pairs(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "One", "one two", "ONE two", "Éa b\tc", "\x0b x"]
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(400)) for _ in range(12)]
    for text in base:
        words = text.split()
        texts += [text, text, text.upper()]
        for _ in range(3):
            words[rng.randrange(400)] = "new"
            texts.append(" ".join(words))
    rows = [(i, text, "x") for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    found = {r["id"]: r for r in simhash_groups(df).collect()}
    prints = [plain_print(text) for text in texts]
    label = plain_components(prints)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {
        i: (f"{prints[i]:016x}", label[i]) for i in range(len(texts))}


def test_rows_without_id_repeats_and_no_rows(spark):
    shape = "doc_id long, text string"
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "z y")], shape)
    found = [(r["id"], r["component_id"]) for r in simhash_groups(df).collect()]
    assert sorted(found, key=str) == sorted([(3, 3), (3, 3), (None, 3), (None, None)], key=str)
    assert simhash_groups(spark.createDataFrame([], shape)).collect() == []


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_walk_finds_all_pairs_once(budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {b for b in base}
    for b in base:
        for _ in range(12):
            values.add(b ^ sum(1 << bit for bit in rng.sample(range(64), rng.randrange(1, 6))))
    laid = np.array(sorted(values), np.uint64)
    whole = np.array([(0, laid.size)])
    a, b = walk_pairs(laid, whole, whole, 0, budget)
    found = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist()))
    expected = [(i, j) for j in range(laid.size) for i in range(j)
                if (int(laid[i]) ^ int(laid[j])).bit_count() <= budget]
    assert found == sorted(expected)


def test_hot_subtree_is_cut_and_keeps_all_links(spark):
    rng = random.Random(9)
    values = set()
    while len(values) < SUBTREE + 700:  # all alike in their first 40 bits
        values.add((0x123456789A << 24) | rng.getrandbits(24))
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = [(r["high"], r["low"]) for r in links(df, 2).collect()]
    own = np.array(sorted(values))
    pairs = [(i, j) for j in range(own.size)
             for i in np.flatnonzero(np.bitwise_count(own[:j] ^ own[j]) <= 2).tolist()]
    want = spanning_edges(own[[j for _, j in pairs]], own[[i for i, _ in pairs]])
    got = spanning_edges(np.array([a for a, _ in found]), np.array([b for _, b in found]))
    assert {*zip(*map(np.ndarray.tolist, want))} == {*zip(*map(np.ndarray.tolist, got))}


def test_components_of_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(100, 160)]
    star = [(n, 7) for n in range(200, 260)] + [(300, 260 - 1)]
    df = spark.createDataFrame(chain + star + star, "high long, low long")
    found = {r["node"]: r["root"] for r in components(df).collect()}
    assert found == {**{n: 100 for n in range(101, 161)}, **{n: 7 for n in range(200, 260)}, 300: 7}
