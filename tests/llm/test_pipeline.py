"""The pipeline's stages against the operators they call, on small tables."""

import hashlib
import os
import subprocess
import sys

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.queries import all_oracles, all_queries
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.toxicity import score_toxicity, train
from tidemark.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = {*all_queries(), "pipeline"}
    assert names <= set(driver.queries())
    assert {name.split("_")[0] for name in all_queries()} == {f"op{n}" for n in range(1, 14)}
    assert set(all_oracles()) <= names and "pipeline" not in driver.oracle_sql()


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        path = scratch_path(spark, "stage")
        made.write.parquet(path)
        tables.append(docs)
        kept[name], docs = docs, spark.read.parquet(path)
    assert all(one.columns == tables[0].columns for one in tables)
    first, second, third, last = tables
    model = train(first, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["id"] for r in score_toxicity(first, model).where("NOT toxic").collect()}
    assert clean == {r["doc_id"] for r in second.collect()}
    lowest = {r["id"] for r in simhash_groups(second).where("id = component_id").collect()}
    assert lowest == {r["doc_id"] for r in third.collect()}
    free = {r["id"] for r in find_contamination(third, benchmark).where("n_hit = 0").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in last.collect()}
    assert free == set(texts) and len(free) < third.count()
    for row in docs.collect():
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
        assert row["ids_sha256"] == hashlib.sha256(row["ids"]).hexdigest()
        assert len(row["ids"]) == 4 * row["n_tokens"]


def test_near_copies_keep_one_of_rows_that_share_ids(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (2, "q r s t", "x"),
            (2, "other text altogether here", "x"), (None, "k l m n", "x"), (None, "k l m n", "x"), (5, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted(
        [(1, "a b c d"), (2, "q r s t"), (2, "other text altogether here"), (None, "k l m n"), (4, "")], key=str)


@pytest.mark.parametrize("gone", [("tidemark/llm", "corpus_pipeline.py")])
def test_the_rest_stands_without_this_part(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("tidemark", "__spark_entry__.py"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name not in {g.split("/")[0] for g in gone} else None
    os.makedirs(tmp_path / "tidemark")
    for name in os.listdir(f"{root}/tidemark"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/tidemark/{name}", tmp_path / "tidemark" / name)
    with open(f"{root}/__spark_entry__.py") as file:
        text = file.read()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(text)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    queries, oracles = map(int, said.stdout.split())
    assert queries == oracles == len(driver.queries()) - len(all_queries()) - 1
