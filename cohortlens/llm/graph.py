"""Connected components of a pair table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node it is connected to.

    Each round hangs a node's larger neighbours, then its smaller ones, on the least of them,
    until only stars are left; a node of any degree is one key of a sum and of a join, which is
    split if it is hot. Every round is written to the shared folder.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u > v").distinct(), "links")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            hung.select("u", F.col("m").alias("v"))).distinct()
        now = staged(small, "links")
        # done when all that is left are stars: a node hangs on one other, which hangs on none
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")),
                                            F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))).alias("e")).select("e.*")
        wrong = ends.groupBy("node").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 or n = 1 and least = 0")
        if wrong.isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return staged(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
