"""Reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut a plan's lineage: the rows are kept in `spark.checkpoint.dir`, so a lost executor costs a re-read.

    Only where that setting is absent and Spark runs in one process (tests) is a temporary folder used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\[]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table to broadcast, once its rows are counted; more than `most` are an error, as a nested loop over them would not end."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows cannot be met by every row of the other side")
    return F.broadcast(df)
