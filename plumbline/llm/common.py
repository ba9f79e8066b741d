"""What several operators of this subpackage share: durable intermediate tables, ranks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Those six, in a pattern's brackets and themselves.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of a row group of intermediate tables, which a task gathers in memory.
ROW_GROUP_BYTES = 32 << 20
#: Rows whose Python objects a function of arrays holds at once.
SLICE_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, taken from `spark.checkpoint.dir`.

    Only where that setting is absent and Spark runs in one process (tests) is a temporary folder used.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\[]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def frees(function: Callable) -> Callable:
    """An Arrow function of batches or of arrays that gives memory back to the system after each batch.

    One of arrays gets `SLICE_ROWS` rows at a time.
    Python workers outlive their tasks, and a stage with several functions has a worker for each. What
    Arrow's pool and the worker keep for later adds up over the stages of a pipeline.
    """
    if not inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def whole(*args):
            starts = range(0, max(1, len(args[0])), SLICE_ROWS)
            out = pa.concat_arrays([function(*(x.slice(start, SLICE_ROWS) for x in args)) for start in starts])
            pa.default_memory_pool().release_unused()
            return out

        return whole

    @functools.wraps(function)
    def piecewise(*args):
        try:
            for out in function(*args):
                yield out
                pa.default_memory_pool().release_unused()
        finally:
            pa.default_memory_pool().release_unused()

    return piecewise


def trim() -> None:
    """Give what the C library keeps of freed arrays back to the system, as Python workers outlive their tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read of the table, not the work before it. The table
    goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(col: Column) -> Column:
    """CRC-32 of an id's decimal text; null for a null id."""
    return F.crc32(col.cast("string").cast("binary"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the rank (from 1) of each row in a total order without bringing all rows to one task.

    Rows are range-partitioned, numbered inside their partition, and shifted by the rows of the
    partitions before it; only one count for each partition meets in one place.
    """
    ordered = saved(df.orderBy(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    inner = ordered.withColumn(
        "__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    )
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        F.col("__part").alias("__p"),
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__before"),
    )
    return (
        inner.join(F.broadcast(before), inner["__part"] == before["__p"])
        .withColumn(name, F.col("__in") + F.col("__before"))
        .drop("__part", "__in", "__p", "__before")
    )
