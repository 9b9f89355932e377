"""Connected components of a table of links, in rounds of joins.

Large-star and small-star turns: every node's larger neighbours, then its smaller ones, are tied
to the least node around it, until the links are stars around each component's least node. Each
round is written to the shared folder; no links reach the driver, only a count and a checksum.
A node with very many links is a skewed join key, which Spark splits, and its least neighbour
is found by pre-aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitehazard.llm.common import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours to the least node around: larger ones, or smaller ones and the node."""
    around = links.select("u", "v")
    if large:
        around = around.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        around = around.where("v > u")
    tied = around.join(least, "u").select(F.col("v").alias("u"), "m")
    if not large:
        tied = tied.unionAll(least.select("u", "m"))
    return tied.where("u <> m").select("u", F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link; a component is named by its least node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = settle(edges.distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
        edges = settle(_star(_star(edges, large=True), large=False), "links")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
