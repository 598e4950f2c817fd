"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = (edges.join(least, "u").filter(F.col("v") != F.col("least"))
             .select(F.col("v").alias("u"), F.col("least").alias("v")))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) of every id that has a link; component_id is its smallest id.

    Each round hangs the larger neighbours of a node on its smallest one, then the
    smaller ones; the rounds grow with the logarithm of the number of nodes.  Nothing
    but a count and a checksum reaches the driver.  No links give no rows.
    """
    edges = (links.filter(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges = stored(edges, "links")
    before, now = None, _signature(edges)
    while now != before and now[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        before, now = now, _signature(edges)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
