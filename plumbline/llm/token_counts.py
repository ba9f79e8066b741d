"""Token counts of the documents in flat token files that have no index.

A flat token file is nothing but the ids of document after document, each closed by an end-of-document
id. Blocks of such files are searched for that id independently, with one vectorised comparison each;
a prefix scan over the blocks of a file (how many documents begin before a block, where the last
separator before it stands) then stitches documents that cross block boundaries.

Defined results: ids after a file's last separator form a document that is not terminated. Two
separators in a row enclose a document of 0 tokens. An empty file has no documents. Bytes that do not
fill an id at a file's end are an error, as the file is not what it is said to be. A text that spells out
`<|endoftext|>` has that token's id among its own; streams of texts are therefore closed by `STREAM_END`. Documents are
counted by their place in a stream, so rows with null or repeated ids, and rows alike in all, are counted one by one, and there
are no ties. A null text counts as empty. Columns beyond id and text are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frees, saved
from .tokens import END_OF_TEXT, token_ids

#: Bytes of a block; a multiple of any id size.
BLOCK_BYTES = 512 * 1024
#: The id that closes a document in `token_stream`: the first beyond the vocabulary, so no text holds it.
STREAM_END = END_OF_TEXT + 1

_SCAN = "file_id string, block long, n_tokens long, n_ends long, first_end long, last_end long, starts array<long>, sizes array<long>"
_SCAN_ARROW = pa.schema(
    [("file_id", pa.string())]
    + [(n, pa.int64()) for n in ("block", "n_tokens", "n_ends", "first_end", "last_end")]
    + [("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
)


def blocks_of_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (file_id, block, payload) of raw token files of up to 2 GB, read through Spark."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    first = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes))
    return files.select(F.col("path").alias("file_id"), "content", F.explode(first).alias("block")).select(
        "file_id", "block", F.expr(f"substring(content, cast(block * {block_bytes} as int) + 1, {block_bytes})").alias("payload")
    )


def token_stream(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Write documents as flat streams of 16-bit ids, one stream for each task, stored in blocks.

    A block's payload is cut wherever it is full, without regard to documents. Beside it, `doc_ids` lists
    the documents that were opened while the block was written, in order; it holds no positions.
    """

    @frees
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = str(TaskContext.get().partitionId()), 0
        parts: list[np.ndarray] = []
        held, opened = 0, []
        most = block_bytes // 2

        def out(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"file_id": [name], "block": [block], "payload": [ids.astype("<u2").tobytes()], "doc_ids": [opened]},
                schema=schema,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.append(np.append(token_ids(text.as_py()), np.uint32(STREAM_END)))
                held += len(parts[-1])
                opened.append(doc_id)
                if held >= most:
                    ids = np.concatenate(parts)
                    while len(ids) >= most:
                        yield out(ids[:most])
                        ids, block, opened = ids[most:], block + 1, []
                    parts, held = [ids], len(ids)
        if held:
            yield out(np.concatenate(parts))

    schema = pa.schema(
        [("file_id", pa.string()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
    )
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(tasks, "file_id string, block long, payload binary, doc_ids array<long>")


def count_tokens(blocks: DataFrame, end_id: int = END_OF_TEXT, id_bytes: int = 2) -> DataFrame:
    """Documents of flat token files given as blocks: file_id, document (from 0), start, n_tokens, terminated."""
    kind = f"<u{id_bytes}"

    @frees
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, block, payload in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ids = np.frombuffer(payload.as_buffer(), kind)
                ends = np.flatnonzero(ids == end_id)
                n = len(ends)
                first, last = (int(ends[0]), int(ends[-1])) if n else (None, None)
                rows.append((file_id.as_py(), block.as_py(), len(ids), n, first, last, ends[:-1] + 1, np.diff(ends) - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCAN_ARROW)], schema=_SCAN_ARROW
            )

    found = saved(blocks.select("file_id", "block", "payload").mapInArrow(scan, _SCAN), "token-scan")
    # The prefix scan sees a few numbers for each block, never the documents.
    order = Window.partitionBy("file_id").orderBy("block")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(prior), F.lit(0))
    stitched = (
        found.select("file_id", "block", "n_tokens", "n_ends", "first_end", "last_end")
        .withColumn("base", base)
        .withColumn("document", F.coalesce(F.sum("n_ends").over(prior), F.lit(0)))
        .withColumn("open", F.coalesce(F.last(F.col("base") + F.col("last_end") + 1, True).over(prior), F.lit(0)))
        .withColumn("is_last", F.lead("block").over(order).isNull())
    )
    crossing = stitched.where("n_ends > 0").select(
        "file_id", "document", F.col("open").alias("start"),
        (F.col("base") + F.col("first_end") - F.col("open")).alias("n_tokens"), F.lit(True).alias("terminated"),
    )
    size, stop = F.col("base") + F.col("n_tokens"), F.coalesce(F.col("base") + F.col("last_end") + 1, F.col("open"))
    tail = stitched.where("is_last").where(size > stop).select(
        "file_id", (F.col("document") + F.col("n_ends")).alias("document"), stop.alias("start"),
        (size - stop).alias("n_tokens"), F.lit(False).alias("terminated"),
    )
    inside = (
        found.where(F.size("starts") > 0)
        .select("file_id", "block", "starts", "sizes")
        .join(stitched.select("file_id", "block", "base", "document"), ["file_id", "block"])
        .select("file_id", "base", "document", F.posexplode(F.arrays_zip("starts", "sizes")).alias("i", "x"))
        .select(
            "file_id", (F.col("document") + 1 + F.col("i")).alias("document"), (F.col("base") + F.col("x.starts")).alias("start"),
            F.col("x.sizes").alias("n_tokens"), F.lit(True).alias("terminated"),
        )
    )
    return crossing.unionByName(inside).unionByName(tail)


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of documents by id: written as a flat stream, searched for its separators, named again."""
    stream = saved(token_stream(docs, id_col, text_col), "token-stream")
    counted = count_tokens(stream, end_id=STREAM_END)
    order = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = stream.select("file_id", "block", F.size("doc_ids").alias("n")).withColumn(
        "first", F.coalesce(F.sum("n").over(order), F.lit(0))
    )
    named = (
        stream.select("file_id", "block", "doc_ids")
        .join(opened.select("file_id", "block", "first"), ["file_id", "block"])
        .select("file_id", F.col("first"), F.posexplode("doc_ids").alias("i", "doc_id"))
        .select("file_id", (F.col("first") + F.col("i")).alias("document"), "doc_id")
    )
    return named.join(counted, ["file_id", "document"]).select("doc_id", "file_id", "document", "start", "n_tokens")
