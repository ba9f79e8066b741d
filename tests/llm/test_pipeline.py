import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import language_id, packing, quality_rules

from .test_minhash_dedup import _brute
from .test_source_mixing import _fill


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).persist()
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name in ("language", "quality", "near_duplicates"):
            assert 0.3 < docs.count() / before.count() <= 1
            assert not docs.join(before, "doc_id", "left_anti").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    clean = kept["language"].join(labels, "doc_id").where(F.size(F.split("text", r"\s+")) >= 30)
    assert clean.join(kept["quality"], "doc_id", "left_semi").count() >= 0.97 * clean.count()
    mixed = kept["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed <= 3
    assert docs.where(F.length("ids") != 4 * F.col("length")).count() == 0
    assert docs.agg(F.sum("length")).first()[0] == packing.pack(kept["mixing"]).agg(F.sum("length")).first()[0]


def test_stages_against_brute_force(spark, sf):
    """Each stage's rows from its own input, by plain loops over all of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    model = language_id.train(docs)
    coders = [(name, language_id._compressor(content)) for name, content in model.dictionaries]
    told = {r["doc_id"]: language_id.classify(r["text"], coders, language_id.MIN_MARGIN) for r in rows}
    first = stages["language"](spark, docs, sf).collect()
    assert {r["doc_id"]: (r["lang"], r["text"]) for r in first} == {r["doc_id"]: (r["lang"] or told[r["doc_id"]][0], r["text"]) for r in rows if not told[r["doc_id"]][2]}

    second = stages["quality"](spark, spark.createDataFrame(first, docs.schema), sf).collect()
    judged = {r["doc_id"]: quality_rules.judge_text(r["text"]) for r in first}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in second} == {i: (x[-1], len(x[-1])) for i, x in judged.items() if x[6]}

    third = stages["near_duplicates"](spark, spark.createDataFrame(second, docs.schema), sf).collect()
    components = _brute([(r["doc_id"], r["text"]) for r in second], 5, 80)
    assert sorted(r["doc_id"] for r in third) == sorted({component for _, _, component in components})

    fourth = stages["mixing"](spark, spark.createDataFrame(third, docs.schema), sf).collect()
    sizes, taken = Counter(), Counter()
    for r in third:
        sizes[r["source"]] += len(r["text"].encode().split())
    for r in fourth:
        taken[r["source"]] += len(r["text"].encode().split())
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    targets = dict(zip(names, _fill([sizes[x] for x in names], [i % 3 + 1 for i in range(len(names))], 3), strict=True))
    assert all(abs(taken[x] - targets[x]) <= 1 for x in names)

    last = stages["packing"](spark, spark.createDataFrame(fourth, docs.schema), sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = sorted((r["doc_id"], tuple([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0])) for r in fourth)
    assert sum(r["length"] for r in last) == sum(len(ids) for _, ids in whole)
    held = Counter()
    for r in last:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        held.update((r["doc_id"], int(x)) for x in ids)
    assert held == Counter((i, x) for i, ids in whole for x in ids)


def test_edge_rows(spark, sf):
    clean = "The surveyors walked along the river and wrote down what they saw, until the evening came and it was time to go home again."
    german = "Die Vermesser gingen am Fluss entlang und schrieben auf, was sie sahen, bis der Abend kam und es Zeit war, wieder nach Hause zu gehen."
    long = " ".join(f"Sentence {i} of a long report says that station {i * 7} stood by the road." for i in range(20_000))
    rows = [
        (None, None, None, None, None), (1, "", "en", "s", 0), (2, "x " * 30_000, "en", None, 60_000), (2, "x " * 30_000, "en", None, 60_000),
        (3, clean, "en", "s", 0), (3, clean, "en", "s", 0), (None, clean + " So they did.", "en", "s", 0), (4, german, None, "s", 0), (5, german, "de", None, 0), (6, long, "en", "t", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("text2", F.lit("kept")).withColumn("node", F.lit(1))
    seen = {}
    for empty in (False, True):
        left = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, left, sf)
            if empty:
                assert out.count() == 0
            else:
                seen[name] = sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()))
                assert name == "packing" or out.columns == docs.columns
            left = left if name == "packing" else out
    ids = lambda name: [None if null else i for null, i in seen[name]]
    assert ids("language") == [2, 2, 3, 3, 4, 5, 6, None] or ids("language") == [3, 3, 4, 5, 6, None]
    assert ids("quality") == [3, 3, 4, 5, 6, None]
    assert ids("near_duplicates") == [3, 4, 6, None]
    assert set(ids("mixing")) <= {3, 4, 6, None} and 6 in ids("mixing")
    assert set(ids("packing")) == set(ids("mixing"))
