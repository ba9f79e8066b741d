import random

import numpy as np

from plumbline.llm import token_counts
from plumbline.llm.queries import op3_token_counts
from plumbline.llm.tokens import END_OF_TEXT, token_ids


def test_raw_files_against_brute_force(spark, tmp_path):
    rng, want = random.Random(3), []
    for f in range(3):
        ids = [rng.choice([9, 5, 6, 7, 8]) for _ in range([0, 1000, 333][f])]
        np.array(ids, "<u2").tofile(tmp_path / f"{f}.bin")
        start = n = 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((f, n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.append((f, n, start, len(ids) - start, False))
    for size in (2, 6, 64, 4096):
        blocks = token_counts.blocks_of_files(spark, str(tmp_path), size)
        got = token_counts.count_tokens(blocks, end_id=9).collect()
        rows = [(int(r["file_id"][-5]), r["document"], r["start"], r["n_tokens"], r["terminated"]) for r in got]
        assert sorted(rows) == sorted(want)


def test_documents(spark):
    texts = [(1, "one two"), (2, None), (3, ""), (4, "x" * 40_000), (4, "x"), (None, "null id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'clash' AS block", "1 AS file_id")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.document_token_counts(docs).collect())
    assert got == sorted((i or 0, len(token_ids(t))) for i, t in texts)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.document_token_counts(none).count() == 0


def test_a_text_that_spells_out_the_end_token(spark):
    texts = [(1, "one two"), (2, "a<|endoftext|>b"), (3, "<|endoftext|>"), (4, "four words are here"), (5, None), (6, "six")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.document_token_counts(docs).collect())
    assert got == [(i, len(token_ids(t))) for i, t in texts]
    assert got[1] == (2, 3) and token_counts.STREAM_END == 50257


def test_query_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], len(token_ids(r["text"]))) for r in docs)
    assert sorted(map(tuple, op3_token_counts(spark, sf).collect())) == want
    assert END_OF_TEXT not in set(token_ids(docs[0]["text"]))
