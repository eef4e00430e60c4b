"""Connected components of an edge list, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, remove, save_at, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge of ``edges`` (two columns of whole numbers); root: the smallest node reachable.

    Each round points neighbours at smaller ones, in joins and grouped minima over edges alone, writes what is left and
    removes what the round before wrote. A node of very many edges is joined by broadcast, so its edges stay where they
    are. Rounds grow with the logarithm of the largest component's diameter, and nothing but counts reach the driver.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    e, path = save_at(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        count, marks = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, marks) == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = count, marks
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        with scratch(spark) as keep:
            least = save_at(least, "least")[0]
            large = join_keyed(both.where("v > u"), least, ["u"], 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = save_at(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")[0]
            least = large.groupBy("u").agg(F.min("v").alias("m"))  # a node's larger ones are gone, so few edges are left to it
            small = large.join(least, "u")
            small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            e, new = save_at(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
            keep(new)
        remove(spark, path)
        path = new
