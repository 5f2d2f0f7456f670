"""The toxicity classifier: held-out accuracy, and rows of all kinds."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm.toxicity import (
    Scorer, calibrate, drop_toxic, fit, score_toxicity, train, word_buckets,
)
from tidemark.llm.common import alnum_words

BAD = ["vile", "scoundrel", "wretch"]


def made(count):
    rng = random.Random(8)
    rows = []
    for ident in range(count):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((ident, " ".join(words), rng.choice(["en", "de"]), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = made(900)
    docs = spark.createDataFrame([(i, t, l, 0.5) for i, t, l, _ in rows],
                                 "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(None, 1), (5000, None)],
                                   "doc_id long, toxic int")
    return rows, docs, train(docs, labels)


def test_held_out_rows(trained):
    rows, docs, model = trained
    got = {r["id"]: r for r in score_toxicity(docs, model).collect()}
    held = [(i, y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(got[i]["score"] >= 0.3) == bool(y) for i, y in held]
    assert len(held) > 150 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["toxic"] == (r["score"] >= r["threshold"]) for r in got.values())
    assert set(model.thresholds) == {None, "en", "de"}
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}


def test_rows_of_all_kinds(spark, trained):
    _, _, model = trained
    rows = [(1, None, None), (2, "", "en"), (3, "...", "xx"), (4, "w1 " * 100_000 + "vile", "en"),
            (4, "w1 " * 100_000 + "vile", "de"), (None, "vile", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = score_toxicity(df, model).collect()
    scores = {r["id"]: r["score"] for r in found}
    assert len(found) == len(rows) and scores[1] == scores[2] == scores[3]
    assert scores[4] > scores[1] and scores[None] > 0.3
    assert len({r["score"] for r in found if r["id"] == 4}) == 1
    assert score_toxicity(df.limit(0), model).collect() == []
    assert {r["threshold"] for r in score_toxicity(df.drop("lang"), model).collect()} == {model.thresholds[None]}
    assert drop_toxic(df.limit(0), model).collect() == []


def test_scores_do_not_depend_on_the_batch(trained):
    rows, _, model = trained
    texts = [t.encode() for _, t, _, _ in rows[:80]] + [b"", b"new words only"]
    together = Scorer(model).scores(texts)
    assert np.allclose(together, [Scorer(model).scores([one])[0] for one in texts], atol=1e-6)


def test_too_few_labels(spark):
    docs = spark.createDataFrame([(0, "a b", "en")], "doc_id long, text string, lang string")
    for labels in ([], [(0, 0)], [(0, None)]):
        model = train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert 0 <= score_toxicity(docs, model).first()["score"] < 0.6


def test_thresholds():
    scores = np.array([0.9, 0.8, 0.4, 0.2, 0.7, 0.6])
    labels = np.array([1, 1, 0, 0, 0, 0])
    found = calibrate(scores, labels, ["a", "a", "a", "a", "b", "b"])
    assert found == {None: pytest.approx(0.75), "a": pytest.approx(0.6)}
    assert calibrate(np.array([]), np.array([]), []) == {None: 0.5}


def test_the_slope_leads_down():
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(50)] + [b"vile"]
    docs = [[words[i] for i in rng.integers(0, 50, 20)] for _ in range(200)]
    labels = rng.integers(0, 2, 200)
    docs = [one + [b"vile"] if y else one for one, y in zip(docs, labels)]
    laid = [np.array([word_buckets(w) for w in one]) for one in docs]
    model = fit(laid, labels.astype(np.float32))
    scores = Scorer(model).scores([b" ".join(one) for one in docs])
    assert ((scores > 0.5) == labels).all()
    assert alnum_words(b"Vile, w1") == [b"vile", b"w1"]


def test_every_labelled_row_counts(spark, monkeypatch):
    import tidemark.llm.toxicity as toxicity

    rows = made(1200)
    docs = spark.createDataFrame([(i, t, l) for i, t, l, _ in rows] + [(1, "w1 vile " * 200_000, "en")],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 250)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 80)
    shards = toxicity._shards(docs, labels, "doc_id", "text", "lang", "doc_id", "toxic")
    written = shards.collect()
    used = [i for i, _, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    extra = int(zlib.crc32(b"1") % 4 != 2)  # a text over 1 MB, of an id that another row has too
    assert len({row["shard"] for row in written}) > 3 and len(written) == len(used) + extra
    assert max(len(row["buckets"]) for row in written) == 6 * (400_000 if extra else 59)
    model = train(docs, labels)
    assert set(model.thresholds) == {None, "en", "de"}
    score = dict(score_toxicity(docs.where("length(text) < 9999"), model).select("id", "score").collect())
    held = [(i, y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(score[i] >= 0.3) == bool(y) for i, y in held]) > 0.95


def test_thresholds_by_spark_are_those_of_all_rows(spark):
    import tidemark.llm.toxicity as toxicity

    rng = random.Random(4)
    for count in (0, 1, 40, 3000):
        rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([0.0, 1.0, 0.25, rng.random() ** 8]))
                for _ in range(count)]
        rows = [(lang, score, 0 if lang == "c" else int(rng.random() < score)) for lang, score in rows]
        found = toxicity.best_thresholds(
            spark, spark.createDataFrame(rows, "lang string, score double, label int"))
        langs, scores, labels = zip(*rows) if rows else ((), (), ())
        assert found == calibrate(np.array(scores), np.array(labels), list(langs))


def test_a_long_text_is_trained_in_pieces(monkeypatch):
    import tidemark.llm.toxicity as toxicity

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 90, (size, 3)) for size in (0, 1, 700, 40, 64, 3)]
    labels = np.array([0, 1, 1, 0, 1, 0], np.float32)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 40)
    whole = fit(docs, labels)
    monkeypatch.setattr(toxicity, "RUN_WORDS", 64)
    assert np.allclose(whole.vectors, fit(docs, labels).vectors, atol=1e-3)


def test_a_shard_hands_on_all_that_it_learnt():
    import tidemark.llm.toxicity as toxicity

    start = toxicity.begin(np.full(toxicity.BUCKETS, 5), 0.4)
    end = toxicity._copied(start)
    end.vectors[7] += 1e-4  # a step too small for the spread
    end.vectors[9], end.spread[9] = 3, 2
    for number, one in enumerate([*end.dense, *end.first, *end.second]):
        one += number
    batch = toxicity._changes(start, end)
    assert batch.column("at").to_pylist()[:3] == [7, 9, toxicity.BUCKETS + 1]
    moved = toxicity._moved(start, np.stack([one.to_numpy() for one in batch.columns], 1), 4)
    assert (moved.vectors == end.vectors).all() and (moved.spread == end.spread).all() and moved.step == 4
    for kind in ("dense", "first", "second"):
        assert all((a == b).all() for a, b in zip(getattr(moved, kind), getattr(end, kind)))
