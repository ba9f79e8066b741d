"""A corpus pipeline: language, quality, near-duplicates, mixture, packed sequences.

Each stage takes what its predecessor kept, written as Parquet and read again, so that a lost executor
costs no more than the stage at work.

Defined results, in every stage: an empty table gives an empty one; columns beyond those of `documents` are
kept under their names, but for packing, which returns its own; repeated rows are judged alike, and a null id
is no reason to drop a row before the packing. What becomes of null, empty and very long texts, of missing
languages and sources and of ties is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language_id, minhash_dedup, packing, quality_rules, source_mixing
from plumbline.llm.common import saved


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; a missing language is filled in.

    A null text, one without a letter and one whose best two languages encode it almost alike are rejected
    (`und` and ties among them), and so is every text if no row of the table has both a text and a language.
    Texts of any length are encoded whole.
    """
    model = language_id.train(docs)
    told = docs.withColumn("__told", language_id.language(F.col("text"), model)).where(~F.col("__told.rejected"))
    return told.select(
        *[F.coalesce("lang", "__told.lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns]
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that failed.

    Null, empty and very short texts fail. Texts of any length are judged whole; `n_chars` is that of what is left.
    """
    judged = docs.withColumn("__judged", quality_rules.quality_rules(F.col("text"), ["kept", "clean_text"]))
    text = F.col("__judged.clean_text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return judged.where("__judged.kept").select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    Documents without a word are no duplicates of each other. Rows with a null id all stay. Of rows alike in id
    and text one stays.
    """
    return minhash_dedup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repetitions of documents so that sources have their target weights.

    A null source is a source, after all others. Documents without a word are taken no time. The document at a
    source's cut comes with its first words only; ties there share what is left.
    """
    return source_mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens, with their ids.

    A null or empty text is the end id alone; a text of any length is cut over as many sequences as it needs.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express compression, MinHash or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
