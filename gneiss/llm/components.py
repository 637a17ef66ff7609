"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, materialize, scratch


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that links (a, b) name: the smallest node reachable from it.

    Links may repeat, go either way and join a node to itself; nodes without a link to another are left
    out. Each round joins the links with one minimum for each node, both written tables, so a hub is a skewed
    join, which adaptive execution splits, and never a list in one task. The rounds end when no link changes, after a
    number that grows with the logarithm of a component's size.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialize(edges), None
    while True:
        with scratch(spark):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = materialize(large)
            least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
            joined = large.join(least, "u")
            onward = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            after = keep(materialize(onward.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()))
        discard(spark, [edges._gneiss_path])
        edges = after
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
