"""Connected components of a table of links, by alternating large and small stars.

Nodes are longs; the component of a node is its smallest reachable node. Each round hangs the larger neighbours of a node
on its smallest one (large star), then the smaller ones too (small star), until nothing changes; that takes about as many
rounds as the logarithm of the longest path squared. Links lie in the shared folder between rounds, so an executor's loss
costs one round. Nothing is collected, and a node with very many links is a matter of combined minima and one join, which
Spark can split.

Links with a null end and links from a node to itself are left out; repeated links count once; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridmail.llm.common import forget, stored


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Links point from the larger to the smaller node."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select("a", F.col("m").alias("b")).unionAll(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for each node of a link that isn't the smallest of its component."""
    spark = links.sparkSession
    now = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stored(now, "links")
    state = None
    while True:
        following, following_path = stored(_small(_large(now)), "links")
        mark = following.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        forget(spark, path)
        now, path = following, following_path
        if state == (mark["n"], mark["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = (mark["n"], mark["h"])
