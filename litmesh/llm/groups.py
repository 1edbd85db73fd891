"""Listing the pairs of groups, and the members' classes by connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmesh.operators import graph
from litmesh.operators.items import last_deliveries
from litmesh.session import stage


def latest(items: DataFrame, *columns: str) -> DataFrame:
    """One row for each item_id: of its deliveries the last by (synced_at, seq)."""
    return last_deliveries(items, "item_id", *columns)


def group_pairs(members: DataFrame, group: str, member: str, *, width: int = 256) -> DataFrame:
    """All pairs (a < b) of different members of each group; members are distinct within a group.

    Groups of up to `width` members are listed in place. A larger one is cut into blocks of about
    `width`, and each two blocks are paired in a task of their own, so that no task holds a group.
    """
    rows = members.select(F.col(group).alias("g"), F.col(member).alias("m"))
    sizes = stage(rows.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > 1))
    big = sizes.where(F.col("c") > width)
    small = rows.join(sizes.where(F.col("c") <= width).select("g"), "g").groupBy("g").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    at = small.select("ms", F.posexplode("ms").alias("i", "a"))
    listed = at.select("a", F.explode(F.slice("ms", F.col("i") + 2, F.size("ms"))).alias("b"))
    if big.isEmpty():
        return listed
    blocks = rows.join(big, "g").withColumn("n", F.ceil(F.col("c") / width)).withColumn("k", F.pmod(F.xxhash64("m"), F.col("n")))
    left = blocks.select("g", F.col("k").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("y"), F.col("m").alias("a"))
    right = blocks.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"), F.col("k").alias("y"), F.col("m").alias("b"))
    return listed.unionByName(left.join(right, ["g", "x", "y"]).where(F.col("a") < F.col("b")).select("a", "b"))


def components(links: DataFrame, a: str = "a", b: str = "b", *, rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: (node, root), root the least node of its component."""
    return graph.components(links.select(F.col(a).alias("a"), F.col(b).alias("b")), rounds).withColumnRenamed("key", "node")
