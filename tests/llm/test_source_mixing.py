import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import source_mixing
from plumbline.llm.queries import ORACLE_SQL, op2_source_mixing


def _fill(sizes, weights, epochs):
    """Water-filling by hand."""
    total, clamped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        level = (total - sum(epochs * sizes[i] for i in clamped)) / sum(weights[i] for i in free)
        over = {i for i in free if epochs * sizes[i] < level * weights[i]}
        if not over:
            return [epochs * sizes[i] if i in clamped else level * weights[i] for i in range(len(sizes))]
        clamped |= over


def test_against_brute_force(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}" if i % 11 else None) for i in range(300)] + [(7, "w w", "tiny"), (8, None, "tiny"), (9, "", "void"), (7, "w w", "tiny"), (None, "a b c", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS size", "1 AS target")
    found = source_mixing.mix_counts(docs).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    targets = _fill(sizes, [i % 3 + 1 for i in range(len(names))], 3)
    for s, size, target in zip(names, sizes, targets, strict=True):
        assert all(r["source_size"] == size and r["target"] == pytest.approx(target) for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 2
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    again = source_mixing.mix_counts(docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mixing.mix_counts(none).count() == 0
    assert source_mixing.mixed_documents(none).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 5 + 1)), "a" if i % 3 else "b", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in source_mixing.mix_counts(docs).collect()}
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == {k: v for k, v in taken.items() if v}


def test_query_against_sql(spark, sf):
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")  # noqa: F841  named in the SQL
    want = duckdb.sql(ORACLE_SQL["op2_source_mixing"]).fetchall()
    got = [tuple(r) for r in op2_source_mixing(spark, sf).collect()]
    assert sorted(want) == sorted(got)


def test_the_cut_does_not_depend_on_how_buckets_are_refined(spark, monkeypatch):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(400)] + [(None, "a b", "s1")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = sorted(map(str, source_mixing.mix_counts(docs).collect()))
    monkeypatch.setattr(source_mixing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(source_mixing, "DIGITS", 1)
    assert sorted(map(str, source_mixing.mix_counts(docs).collect())) == once


def test_words_are_counted_and_cut_as_the_pattern_says(spark):
    import re

    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a b  c d\x1ce\n", "x" * 50_000 + " y" * 50_000, "\x85a \x00 b", "\U0001f600 ́e\r\nf$1 \\2"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("text", F.col("text"))
    found = docs.select("text", source_mixing.word_count(F.col("text")).alias("n"), source_mixing.first_words(F.col("text"), F.lit(2)).alias("two")).collect()
    for r in found:
        words = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        assert r["n"] == len(words)
        assert (r["two"] or "") == ((r["text"] or "")[: words[:2][-1]] if words else "")
