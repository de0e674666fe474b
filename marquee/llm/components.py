"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step replaces links by links to the smallest neighbour; minima are aggregated before the shuffle, and
the joins on a node with very many links can be split, as each has one row per node on its other side.
Every round is written and read back, so neither lineage nor memory grows with the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import stage


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of u are linked to u's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_minima(both), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end of each link) and its neighbours are linked to the smallest of these."""
    return (edges.join(_minima(edges), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                                      F.struct(F.col("u"), F.col("low").alias("v")))).alias("e"))
            .select("e.*").filter("u > v").distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another one; component is the smallest node it reaches."""
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, edges = mark, stage(_small_star(_large_star(edges)), "links")
