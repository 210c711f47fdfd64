"""Connected components of a link table, by alternating large and small stars.

Every round makes two grouped minima and two joins; no node's links are gathered in
one place, and a hub is one row after the map-side minimum. Rounds are written to the
checkpoint folder. The number of rounds grows with the logarithm of the longest chain.

A round has as many tasks as its links need and not as the session has shuffle partitions: a
few thousand links in hundreds of tasks are hundreds of files for each of a round's shuffles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import durable

#: Links of a task.
LINKS = 5_000


def _large(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(parts).distinct().coalesce(parts)


def _small(edges: DataFrame, parts: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts)


def _mark(edges: DataFrame) -> tuple[int, int]:
    # Sums of two halves of a hash: they tell sets of links apart and do not overflow.
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.shiftrightunsigned(h, 40) * 7 + h.bitwiseAND(F.lit(0xFFFFFF))), F.lit(0)).alias("s"),
    ).first()
    return row["n"], row["s"]


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root`` for every node with a link to another; the root is the least node.

    Repeated links, links in both directions and links to itself are harmless; links
    with a null end are ignored.
    """
    a, b = F.col(left), F.col(right)
    edges = durable(
        links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        parts = 1 + mark[0] // LINKS
        edges = durable(_small(_large(edges.coalesce(parts), parts), parts))
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
