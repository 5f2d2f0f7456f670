"""Benchmark passages against brute force."""

import random
import re

from tidemark.llm.decontaminate import drop_contaminated, find_contamination

DOCS = "doc_id long, text string, item_id string, spans string"
ITEMS = "item_id long, text string, doc_id string"


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        for at in range(max(1, len(own) - 9)) if own else ():
            window = own[at:at + 10]
            for start in range(len(words) - len(window) + 1):
                if words[start:start + len(window)] == window:
                    hit.update(range(start, start + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(i for i in found if i is not None)


def test_against_all_windows(spark):
    rng = random.Random(2)
    text = lambda n, of="abc": " ".join(rng.choice(of) for _ in range(n))
    items = [(i, text(rng.randrange(1, 25), "abcdefgh")) for i in range(20)]
    items += [(20, None), (21, ""), (22, "..."), (23, "É-Ü x"), (24, items[3][1]), (3, items[3][1]),
              (None, "only this one"), (25, "A b C D e f g h I j k")]
    docs = [(i, text(rng.randrange(200), "abcdefgh")) for i in range(40)]
    docs += [(50 + i, f"Yes, {items[i][1].upper()}! {items[i + 1][1]} no") for i in range(15)]
    docs += [(90, None), (91, ""), (92, "é-ü X"), (92, "é-ü X"), (None, "a.b,c\nD\te f  g h-i_j k"),
             (93, "Only this ONE"), (94, "x " * 50_000 + items[12][1])]
    df = spark.createDataFrame([(i, t, "q", "q") for i, t in docs], DOCS)
    benchmark = spark.createDataFrame([(i, t, "q") for i, t in items], ITEMS)
    found = find_contamination(df, benchmark).collect()
    got = sorted(((r["id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found), key=str)
    assert got == sorted(((i, *plain(t, items)) for i, t in docs), key=str)
    texts = dict(docs)
    for row in found:
        raw = (texts[row["id"]] or "").encode()
        inside = [words_of(raw[one["start"]:one["end"]].decode()) for one in row["spans"]]
        assert sum(map(len, inside)) == row["n_hit"]
    kept = drop_contaminated(df, benchmark)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(
        (i for i, t in docs if not plain(t, items)[1]), key=str)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b", "", "")], DOCS)
    for rows in ([], [(1, None, "x"), (2, " ", "x")]):
        empty = spark.createDataFrame(rows, ITEMS)
        assert [(r["n_words"], r["n_hit"], r["item_ids"]) for r in find_contamination(docs, empty).collect()] == [
            (2, 0, [])]
        assert drop_contaminated(docs, empty).count() == 1
    items = spark.createDataFrame([(1, "a b", "x")], ITEMS)
    assert find_contamination(docs.limit(0), items).collect() == []
