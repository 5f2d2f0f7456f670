"""Embedding links against brute force over all pairs."""

import duckdb
import numpy as np

from tidemark.llm import pivot_index
from tidemark.llm.pivot_index import directions, link_vectors

SHAPE = "vec_id long, embedding array<float>, kept string"


def plain(ids, rows):
    x = directions(np.array(rows, np.float32))
    links = x @ x.T >= 0.95
    np.fill_diagonal(links, False)
    root = np.array(ids)
    while True:
        low = np.minimum(root, np.where(links, root[None, :], 1 << 60).min(1))
        if (low == root).all():
            break
        root = low
    return {i: (int(n), int(r), i == r) for i, n, r in zip(ids, links.sum(1), root)}


def got(df):
    return {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in link_vectors(df).collect()}


def recall(found, want):
    return sum(n for n, *_ in found.values()) / max(1, sum(n for n, *_ in want.values()))


def test_crowds_copies_and_chains(spark):
    rng = np.random.default_rng(1)
    rows = list(rng.normal(size=(300, 32)))
    crowd = rng.normal(size=32)
    rows += [crowd + 0.02 * rng.normal(size=32) for _ in range(pivot_index.LIST + 400)]
    rows += [rows[0]] * 5 + [2 * rows[1]]
    step = rng.normal(size=32)
    for _ in range(20):  # each within the threshold of the next only
        step = step / np.linalg.norm(step) + 0.04 * rng.normal(size=32)
        rows.append(step)
    rows = [np.float32(row).tolist() for row in rows]
    ids = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(i, row, "x") for i, row in zip(ids, rows)], SHAPE)
    found, want = got(df), plain(ids, rows)
    assert all(found[i][0] <= want[i][0] for i in ids)
    assert recall(found, want) >= 0.99
    if recall(found, want) == 1:
        assert found == want


def test_given_vectors_and_noisy_copies(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}' ORDER BY vec_id").fetchall()
    rng = np.random.default_rng(7)
    for ident, vector in rows[:600]:
        noise = rng.normal(size=len(vector))
        own = directions(np.array([vector, noise]))
        copy = own[0] + rng.uniform(0.05, 0.33) * own[1]
        rows.append((100_000 + ident, np.float32(copy).tolist()))
    want = plain([i for i, _ in rows], [v for _, v in rows])
    found = got(spark.createDataFrame([(*row, None) for row in rows], SHAPE))
    assert sum(n for n, *_ in want.values()) >= 1000
    assert all(found[i][0] <= want[i][0] for i in want)
    assert recall(found, want) >= 0.97


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, 1.0]), (8, [3.0, 3.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (10, [1.0, 1.0, 0.0]),
            (11, [3e38, 3e38]), (12, [1e-40, 1e-40])]
    df = spark.createDataFrame([(*row, None) for row in rows], SHAPE)
    found = sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in link_vectors(df).collect())
    linked = [(i, 5, 7, i == 7) for i in (7, 8, 9, 9, 11, 12)]
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)]
    assert found == sorted(linked + alone)


def test_no_id_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], None), (4, [1.0, 0.01], None), (None, [0.0, 1.0], None)], SHAPE)
    found = [(r["id"], r["n_links"], r["component_id"]) for r in link_vectors(df).collect()]
    assert sorted(found, key=str) == sorted([(None, 1, 4), (4, 1, 4), (None, 0, None)], key=str)
    assert link_vectors(spark.createDataFrame([], SHAPE)).collect() == []
