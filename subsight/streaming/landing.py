"""Landing folders for stream sources (in the shared checkpoint folder).

A file source processes files oldest first, and files of one write share a
modification time. So rows are landed in arrival order as separate chunks,
one file each, written one after another: the stream then sees them in that
order, one chunk per trigger. The number of chunks grows with the rows
(``rows_per_file``), so no chunk file holds more than that many rows."""

from __future__ import annotations

import math
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ids
from ..session import scratch_path

ROWS_PER_FILE = 200_000
BATCHES = 8  # most micro-batches that a landed folder makes


def land(df: DataFrame, name: str, order_col: str, chunks: int | None = None,
         rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write ``df`` as chunk files ordered by ``order_col`` (nulls first);
    returns the folder.

    A row's chunk comes from its exact position, so equal or null order
    values are split over chunks like any others."""
    path = scratch_path(df.sparkSession, f"landing-{name}")
    total = df.count()
    chunks = chunks or max(4, math.ceil(total / rows_per_file))
    size = max(1, math.ceil(total / chunks))
    rows = ids.positions(df, [order_col], "_at")
    chunk = F.floor(F.col("_at") / size).cast("int")
    staged = scratch_path(df.sparkSession, f"staged-{name}")
    rows.withColumn("_chunk", chunk).drop("_at").write.partitionBy("_chunk").parquet(staged)  # the rows are read once
    for i in range(chunks):
        part = _chunk(df, staged, i)
        if part is None:
            continue
        # one file per chunk: files of one write would share a modification
        # time and could be picked up in any order
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # distinct modification times keep arrival order
    return path


def _chunk(df: DataFrame, staged: str, i: int) -> DataFrame | None:
    """The staged rows of one chunk, None if it has none."""
    try:
        return df.sparkSession.read.schema(df.schema).parquet(f"{staged}/_chunk={i}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def files_a_batch(spark: SparkSession, path: str) -> int:
    """Files per trigger for a landed folder: one, or as many as keep its
    micro-batches at ``BATCHES``. A batch costs what its rows do and, besides,
    a look at the tables and a task for each partition of the state; so the
    whole run would grow with the square of the rows if batches stayed small."""
    return max(1, math.ceil(len(spark.read.parquet(path).inputFiles()) / BATCHES))
