"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free sum that tell whether two edge lists differ."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` (smallest node of its component) for the nodes of ``edges``
    (columns ``a``, ``b``), by alternating large-star and small-star steps.

    Minima are aggregated map-side and written before they are joined back, so
    a node with very many links is split by AQE rather than held in one task;
    nothing but two numbers per round reaches the driver.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    mark = _mark(cur)
    while mark[0]:
        both = cur.selectExpr("u as x", "v as y").unionByName(cur.selectExpr("v as x", "u as y"))
        low = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m")), "star")
        large = materialize(both.join(low, "x").where("y > x").selectExpr("y as v", "m as u").distinct(), "edges")
        low = materialize(large.groupBy("v").agg(F.min("u").alias("m")), "star")
        small = large.join(low, "v").where("u <> m").selectExpr("u as v", "m as u").unionByName(low.selectExpr("v", "m as u"))
        cur = materialize(small.distinct(), "edges")
        before, mark = mark, _mark(cur)
        if mark == before:
            break
    return cur.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("comp")) \
        .unionByName(cur.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct().join(
            cur.select(F.col("v").alias("node")), "node", "left_anti"))
