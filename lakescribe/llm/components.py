"""Connected components of a graph whose edges are a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.scratch import remove, written


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).head()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that an edge (u, v) touches; a component is named by its least node.

    Alternates large and small stars until nothing changes: a number of rounds that grows with the logarithm
    of the graph, each with lineage cut. Loops and repeated edges do no harm; nulls are left out. Stars around
    a hot node are counted before each shuffle, and its join is one that Spark can split.
    """
    now, folder = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while True:
        old, (now, folder) = folder, written(_small_star(_large_star(now)))
        remove(edges.sparkSession, old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
