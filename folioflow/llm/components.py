"""Connected components of a table of links, by alternating large and small stars.

A large star links every node's larger neighbours to its least one; a small star links a node and its smaller neighbours to
the least of them. The two alternate until nothing changes, which takes a number of rounds that grows with the logarithm
of a component's size. Every round is written to the shared folder, so that neither lineage nor lost executors matter, and
takes the place of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import fresh_path, remove, stage


def large_star(links: DataFrame) -> DataFrame:
    """links has hi > lo."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of links (a, b); nodes that link with nothing are absent."""
    spark, was = links.sparkSession, None
    path = fresh_path(spark, "links")
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links", path)
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if state == was or not state[0]:
            break
        was = state
        before, path = path, fresh_path(spark, "links")
        now = stage(small_star(large_star(now)), "links", path)
        remove(spark, before)
    # at the end each link joins a node with the least of its component
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
