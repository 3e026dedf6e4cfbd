"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return r["n"], r["h"]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> one row (id, component) for each id on an edge; component is the smallest id reachable.

    Self-loops and repeated edges do no harm; no edges give no rows. A node of
    high degree is pre-aggregated before each shuffle, and the join that hands
    its minimum back can be split by the engine. Each step is cut by a table
    in the shared folder.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(spark, e, "cc")
    before = _digest(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined back, so that a join meets plain tables and can split a hot node
        least = cut(spark, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc")
        large = cut(spark, both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        discard(spark, least)
        least = cut(spark, large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = cut(spark, small, "cc")
        after = _digest(new)
        discard(spark, e, large, least)
        e = new
        if after == before:
            break
        before = after
    rows = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return rows.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
