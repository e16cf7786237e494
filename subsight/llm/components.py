"""Connected components of an edge table, by alternating large and small stars.

Every round is written to the shared folder, so lineage stays short and a lost executor repeats
one round at most. Nothing is collected to the driver but the answer "is it done".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_and_read


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge (columns a, b: long): root is the smallest node
    that can be reached. Nodes without edges do not appear."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = write_and_read(e, "edges")
    while True:
        # large star: a node's larger neighbours go to its smallest one
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        linked = large.join(least, F.col("a") == F.col("u"))
        e = write_and_read(linked.select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
            .select("s.*").filter("a <> b").distinct(), "edges")
        # done when each node has one parent, and no parent has one
        again = e.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a").unionByName(
            e.select("a").join(e.select(F.col("b").alias("p")), F.col("a") == F.col("p"), "left_semi"))
        if again.isEmpty():
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
