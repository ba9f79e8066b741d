import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.queries import op4_packing


def test_closest_multiset_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(0, 8))]
        capacity = rng.randint(0, 30)
        counts = {k: lengths.count(k) for k in lengths}
        sums = {sum(c) for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n)}
        chosen = packing.closest_multiset(counts, capacity)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


def _whole(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for t in texts)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    got = []
    for own in pieces.values():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
        got.append(b"".join(bytes(r["ids"]) for r in own))
    assert sorted(got) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        n = sum(r["length"] for r in own)
        assert n == capacity or n < capacity and n & (n - 1) == 0


def test_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "<|endoftext|> b", "é " * 3000] + [" ".join(rng.choice(["alpha", "beta", "γ", "x1"]) for _ in range(rng.randint(1, 90))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS ids", "2 AS offset")
    for capacity, pool in ((64, 8), (64, 1000), (1024, 4096)):
        _whole(packing.pack(docs.repartition(3), capacity=capacity, pool=pool).collect(), texts, capacity)
    assert packing.pack(docs.limit(0)).count() == 0


def test_query_whole_table(spark, sf):
    rows = op4_packing(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len({r["doc_id"] for r in rows}) == n
    pieces = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(zlib.crc32(bytes(r["ids"])) for r in pieces) == sorted(r["ids_crc32"] for r in rows)
    _whole(pieces, [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], 1024)


def test_a_long_run_of_white_space(spark):
    texts = ["a" + " " * 1_000_000 + "b", "ab " + "\n " * 500_000, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        _whole(packing.pack(docs, ranks_path=ranks).collect(), texts, packing.CAPACITY)
