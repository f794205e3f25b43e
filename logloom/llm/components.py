"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import removed, written


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum of them."""
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("sum")
    ).first()
    return row["n"], row["sum"]


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return ends.where(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    moved = both.where(F.col("v") > F.col("u")).join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("least"))
    return moved.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
        least.select("u", F.col("least").alias("v"))
    )


def components(links: DataFrame, put: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """From links(u, v) to (node, root): each linked node with the least node of its component.

    Nodes are integers; self-links and repeats don't matter; nulls are dropped; no links
    give no rows. Each round replaces paths by stars, so the number of rounds grows
    with the logarithm of the longest path; every round is written to the shared
    folder. The least-neighbour sums are pre-aggregated before the shuffle, and the joins
    back to them may be split where one node has very many links. put writes the tables
    of the rounds; the last one is read by the result.
    """
    spark = links.sparkSession
    edges = put(_downward(links.where("u IS NOT NULL AND v IS NOT NULL")), "links")
    state = _state(edges)
    while state[0]:
        starred = _downward(_large_star(edges))
        contracted = put(_downward(_small_star(starred)), "stars")
        removed(spark, edges)
        edges, before, state = contracted, state, _state(contracted)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
