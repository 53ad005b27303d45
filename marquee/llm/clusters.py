"""Links between sets that meet in candidate buckets, without all pairs of a bucket.

``links`` gets nodes that share buckets and confirms similarity on whole sets:

1. star: each node is compared with one pivot (smallest node of a bucket), the
   one it meets in most buckets; components of the links found;
2. rest: a pivot whose buckets hold nodes of one component needs no more work.
   A mixed one belongs to the largest component among its nodes (its home).
   Per home, nodes outside are compared with those inside and with each other,
   in blocks of about ``BLOCK`` elements: a set travels once per block of the
   other side, blocks pair only within one home, and inside nodes never meet.

Every two nodes that share a bucket and are not of one component after step 1
share the home of that bucket's pivot and are compared, so no link between
components is left out.  A group of M copies with S strays costs about
M + S * M * (set size) / BLOCK rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

STAR = 64  # members compared with one copy of a star's centre
BLOCK = 1 << 19  # elements of the sets in one block


def _as_set(raw) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint64)


def _similar(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


def _star_links(percent: int):
    """Rows sorted by (pivot, part, member): the pivot's own row comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for batch in batches:
            a, b = [], []
            for pivot, part, member, node, raw in zip(*(batch.column(c) for c in ("pivot", "part", "member", "node", "elements")), strict=True):
                if not member.as_py():
                    key, centre = (pivot.as_py(), part.as_py()), _as_set(raw).copy()
                elif key == (pivot.as_py(), part.as_py()):
                    own = _as_set(raw)
                    if _similar(len(np.intersect1d(own, centre, assume_unique=True)), len(own), len(centre), percent):
                        a.append(node.as_py())
                        b.append(key[0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class _Block:
    """Sets held for comparison, as one sorted list of elements with their owners."""

    def __init__(self, nodes: list[int], comps: list[int], sets: list[np.ndarray]):
        self.nodes, self.comps = nodes, np.array(comps)
        self.sizes = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, first = np.unique(values[order], return_index=True)
        self.first = np.concatenate([first, [len(values)]])

    def like(self, own: np.ndarray, comp: int, percent: int) -> list[tuple[int, int]]:
        """A node of each other component that has one similar to ``own``, with its component."""
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        # what the block has of this set bounds what any one of its sets has
        if not _similar(len(at), max(len(own), len(at)), max(int(self.sizes.min()), len(at)), percent):
            return []
        start, size = self.first[at], self.first[at + 1] - self.first[at]
        rows = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        common = np.bincount(self.owner[rows], minlength=len(self.nodes))
        found = np.flatnonzero(_similar(common, self.sizes, len(own), percent) & (self.comps != comp))
        return [(self.nodes[k], int(self.comps[k])) for k in found[np.unique(self.comps[found], return_index=True)[1]]]


def _block_links(percent: int):
    """Rows sorted by (home, low, high, side, node): the sets of the first block, then those of the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        joined: dict[int, int] = {}

        def root(comp: int) -> int:
            top = comp
            while top in joined:
                top = joined[top]
            while comp != top:
                joined[comp], comp = top, joined[comp]
            return top

        for batch in batches:
            a, b = [], []
            for home, low, high, side, node, comp, raw in zip(
                    *(batch.column(c) for c in ("home", "low", "high", "side", "node", "comp", "elements")), strict=True):
                here = (home.as_py(), low.as_py(), high.as_py())
                if here != key:
                    key, held, block = here, [], None
                    joined.clear()
                node, comp, own = node.as_py(), comp.as_py(), _as_set(raw)
                if side.as_py() == 0:
                    held.append((node, comp, own.copy()))
                elif held:
                    block = block or _Block(*map(list, zip(*held, strict=True)))
                    for other, comp_of in block.like(own, comp, percent):
                        one, two = root(comp), root(comp_of)
                        if one != two:  # not joined by an earlier link of this block pair
                            joined[one] = two
                            a.append(node)
                            b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``node``, ``comp`` of the linked nodes.  ``buckets``: ``bucket``, ``node``; ``sets_of`` gets
    rows with a ``node`` and adds ``size`` and ``elements`` (sorted distinct 64-bit integers, packed)."""
    pivots = materialize(buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select("bucket", "pivot"), "pivots")
    met = materialize(buckets.join(pivots, "bucket").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n")), "met")
    # the pivot that a node meets in most buckets; a node that is only ever a pivot itself is its own
    order = Window.partitionBy("node").orderBy(F.col("pivot") == F.col("node"), F.desc("n"), "pivot")
    star = materialize(met.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("node", "pivot"), "stars")
    parts = materialize(star.where("node <> pivot").groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts")), "star-parts")
    # each node with its place in a star, and in how many parts it is the centre; sets travel once
    wanted = star.join(parts, "pivot", "left").select("node", "pivot", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")) \
        .join(parts.select(F.col("pivot").alias("node"), F.col("parts").alias("centre_of")), "node", "left")
    sets = materialize(sets_of(wanted), "sets")
    as_member = sets.where("node <> pivot").select("pivot", "part", F.lit(True).alias("member"), "node", "elements")
    as_centre = sets.where("centre_of is not null").select(
        F.col("node").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("centre_of") - 1)).alias("part"), F.lit(False).alias("member"),
        "node", "elements")
    first = materialize(as_member.unionByName(as_centre).repartition(F.col("pivot"), F.col("part"))
                        .sortWithinPartitions("pivot", "part", "member", "node").select("pivot", "part", "member", "node", "elements")
                        .mapInArrow(_star_links(percent), "a long, b long"), "star-links")
    comps = materialize(components(first), "components")

    # mixed pivots and their homes; what meets a home is inside or outside of it
    weight = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    of = materialize(sets.select("node", "size").join(comps, "node", "left").select("node", "size", F.coalesce("comp", "node").alias("comp"))
                     .join(weight, "comp", "left").select("node", "size", "comp", F.coalesce("weight", F.lit(1)).alias("weight")), "owned")
    owned = met.select("node", "pivot").join(of.select("node", "comp", "weight"), "node")
    homes = materialize(owned.groupBy("pivot").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.struct("weight", "comp")).alias("home"))
        .where("low <> high").select("pivot", F.col("home.comp").alias("home")), "homes")
    around = materialize(met.select("node", "pivot").join(homes, "pivot").select("home", "node").distinct()
                         .join(of.select("node", "size", "comp"), "node")
                         .select("home", "node", "comp", "size", (F.col("home") == F.col("comp")).alias("inside")), "around")
    sizes = around.groupBy("home", "inside").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("parts"))
    sizes = materialize(sizes.groupBy("home").agg(F.coalesce(F.max(F.when(~F.col("inside"), F.col("parts"))), F.lit(0)).alias("out"),
                                                  F.coalesce(F.max(F.when(F.col("inside"), F.col("parts"))), F.lit(0)).alias("ins")), "block-counts")
    # outside blocks come first, inside blocks get the numbers from ``out`` on; a pair is (outside, any later one)
    placed = around.join(sizes, "home").select("home", "node", "comp", "out", "ins", F.when(
        F.col("inside"), F.col("out") + F.pmod(F.xxhash64("node"), "ins")).otherwise(F.pmod(F.xxhash64("node"), "out")).cast("int").alias("block"))
    as_first = placed.where("block < out").withColumn("high", F.explode(F.expr("sequence(block, out + ins - 1)"))) \
        .select("home", F.col("block").alias("low"), "high", F.lit(0).alias("side"), "node", "comp")
    as_second = placed.where("out > 0").withColumn("low", F.explode(F.expr("sequence(0, least(block, out - 1))"))) \
        .select("home", "low", F.col("block").alias("high"), F.lit(1).alias("side"), "node", "comp")
    rest = as_first.unionByName(as_second).join(sets.select("node", "elements"), "node") \
        .repartition(F.col("home"), F.col("low"), F.col("high")).sortWithinPartitions("home", "low", "high", "side", "node") \
        .select("home", "low", "high", "side", "node", "comp", "elements").mapInArrow(_block_links(percent), "a long, b long")
    return components(materialize(rest.unionByName(comps.selectExpr("node as a", "comp as b")), "links"))
