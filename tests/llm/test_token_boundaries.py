"""Token counts against plain encoding, and block scans against plain splitting."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import token_boundaries
from tidemark.llm.byte_bpe import read_ranks
from tidemark.llm.token_boundaries import BLOCK_IDS, count_tokens, scan_token_files

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENCODING = tiktoken.Encoding(
    "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def expected(rows):
    return sorted(((i, len(ENCODING.encode_ordinary(t or ""))) for i, t in rows), key=str)


def got(df):
    found = count_tokens(df, PATH, public_tokenizers.PATTERN, 50256)
    return sorted(((r["id"], r["n_tokens"]) for r in found.collect()), key=str)


def test_texts_of_all_kinds(spark):
    texts = [None, "", "\n", "a\n\n", "12\n34", "<|endoftext|>", "é 漢字", "long text " * 200_000]
    rows = list(enumerate(texts)) + [(3, "a\n\n"), (None, "no id"), (-12, "x"), (2**62, "big"), (None, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    assert got(df) == expected(rows)


def test_given_documents_and_no_rows(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall()
    assert got(spark.read.parquet(path)) == expected(rows)
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("last", [True, False])
def test_documents_through_several_blocks(spark, tmp_path, last):
    rng = np.random.default_rng(last)
    sizes = [0, 5, 3 * BLOCK_IDS + 7, 0, 0, BLOCK_IDS - 20, *rng.integers(0, 9000, 200).tolist()]
    ids = np.concatenate([np.append(rng.integers(10, 99, n), 9) for n in sizes]).astype("<u2")
    (tmp_path / "one").write_bytes((ids if last else ids[:-1]).tobytes())
    (tmp_path / "two").write_bytes(b"")
    (tmp_path / "three").write_bytes(np.array([9], "<u2").tobytes())
    found = scan_token_files(spark, str(tmp_path), 9).orderBy("file", "ordinal").collect()
    own = [r for r in found if r["file"].endswith("one")]
    if not last and sizes[-1] == 0:
        sizes.pop()
    assert [(r["ordinal"], r["n_ids"]) for r in own] == list(enumerate(sizes))
    assert [r["closed"] for r in own] == [True] * (len(sizes) - 1) + [last]
    starts = np.cumsum([0, *(n + 1 for n in sizes)])[:-1]
    assert [r["start"] for r in own] == starts.tolist()
    assert all(r["tail"] == ids[s:s + r["n_ids"]][-token_boundaries.TAIL_IDS:].tolist()
               for r, s in zip(own, starts))
    assert [r["n_ids"] for r in found if r["file"].endswith("three")] == [0]
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="not ids of two"):
        scan_token_files(spark, str(tmp_path), 9).collect()
