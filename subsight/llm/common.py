"""Small helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, as ``--py-files`` does: Spark hands
    the archive out from the driver, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="subsight-py-")), "subsight.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row (a lambda variable is bound, not substituted)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(col: str | Column = "text") -> Column:
    """The text; a null one is empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(F.translate(text, ASCII_SPACE[1:], " " * 5), " "), "")


def count_words(text: Column) -> Column:
    """Number of words: word starts, counted without building the words."""
    blank = F.translate(text, ASCII_SPACE[1:], " " * 5)
    return F.size(F.array_remove(F.split(blank, " "), "")).cast("long")


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    from ..session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
