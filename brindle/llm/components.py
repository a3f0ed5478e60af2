"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brindle.llm.tables import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the component's smallest node.

    Alternating stars (Kiveris et al., SoCC 2014): every node hands its smallest neighbour to its larger,
    then to its smaller neighbours, until each component is one star. The edges never leave the cluster;
    each turn is written to the shared folder, and only a count and a checksum reach the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    current, before = stage(pairs, "stars"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # repeated pairs end in the one distinct below; the row of the smallest neighbour itself stands for its node
        small = (large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        current = stage(small, "stars")
