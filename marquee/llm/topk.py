"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, are range-sorted by length (longest first) and cut
into buckets of ``BUCKET_ROWS``; queries are grouped in blocks.  The bucket of
the longest vectors gives every query a first bound (the k-th best score seen).
Then every query block meets every bucket that its bounds cannot rule out, and
inside a bucket the local cosine threshold ``bound / (|q| * longest)`` decides:

* above 1: the bucket is skipped for the query;
* high: coordinate pruning - a vector whose cosine reaches the threshold has
  its coordinates on the query's largest axes inside a known interval;
* low: length pruning - only vectors of at least ``bound / |q|`` are looked at.

What is left is verified by exact integer products.  Pruning is strict, so
ties with the bound stay and go to the smaller id.

Blocks meet buckets in the cells of a grid (an equi-join on the cell), the
norms of both sides filter the pairs, and a pair leaves at most k rows per
query.  Sorting by (length, id) keeps a vector that occurs very often from
filling one task.

Edge cases: vectors that are null or hold a null or non-finite component take
no part, nor do rows without an id; an empty vector has length 0; only vectors
of equal dimension are compared; a query is not compared with rows of its own
id; rows may repeat and count each; an empty table gives an empty result;
other columns are not read.  Products are exact while they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BUCKET_ROWS = 2048
QUERY_ROWS = 256
CELL_SIDE = 8  # blocks and buckets in a cell
COORDINATE_FROM = 0.6
FOCUS = 4
SALTS = 64
_BLOCK = "block long, dim int, n int, longest double, shortest double, ids binary, rows binary"


def integers(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (array of floor(scale * x)), ``norm`` of the usable rows."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return src.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine) \
        .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")) \
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)))


def _blocked(ints: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of up to ``rows`` vectors of one dimension, longest first; written."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def out():
            nonlocal made
            made += 1
            ids = np.array([h[0] for h in held], dtype=np.int64)
            mat = np.array([h[1] for h in held], dtype=np.int64).reshape(len(held), -1)
            norms = [h[2] for h in held]
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) + made, "dim": mat.shape[1], "n": len(held), "longest": max(norms),
                "shortest": min(norms), "ids": ids.tobytes(), "rows": mat.tobytes()}], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()),
                            ("shortest", pa.float64()), ("ids", pa.binary()), ("rows", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= rows or len(held[0][1]) != len(row["v"])):
                    yield out()
                    held = []
                held.append((row["vec_id"], row["v"], row["norm"]))
        if held:
            yield out()

    keyed = ints.withColumn("dim", F.size("v"))
    order = ["dim", F.desc("norm"), "vec_id"]
    return materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v", "norm")
                       .mapInArrow(build, _BLOCK), name)


def _matrix(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(n, dim)


def _products(rows: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products; through floating point while every partial sum is an exact integer."""
    if bound < 2 ** 52:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return rows @ q


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= edge)
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((ids[pick], -scores[pick]))[:k]]


def candidates(rows: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float, bound: float) -> np.ndarray:
    """Positions in a bucket (longest first) that may reach ``bound``; the others cannot."""
    n = len(rows)
    if bound <= 0 or q_norm == 0:
        return np.arange(n) if bound <= 0 else np.arange(0)
    cosine = bound / (q_norm * norms[0]) if norms[0] else 2.0
    if cosine > 1 + 1e-9:
        return np.arange(0)
    reach = int(np.searchsorted(-norms, -bound / q_norm * (1 - 1e-9), side="right"))
    if cosine < COORDINATE_FROM:
        return np.arange(reach)
    unit = q / q_norm
    cosine = min(cosine, 1.0)
    keep = np.ones(reach, dtype=bool)
    for axis in np.argsort(-np.abs(unit))[:FOCUS]:
        spread = np.sqrt((1 - cosine ** 2) * max(0.0, 1 - unit[axis] ** 2))
        low = -1.0 if unit[axis] <= -cosine else cosine * unit[axis] - spread
        high = 1.0 if unit[axis] >= cosine else cosine * unit[axis] + spread
        share = rows[:reach, axis] / np.maximum(norms[:reach], 1e-300)
        keep &= (share >= low - 1e-9) & (share <= high + 1e-9)
    return np.flatnonzero(keep)


def _pair(row: dict, k: int) -> Iterator[tuple]:
    """Best k of one bucket for each query of one block, as (query, vec_id, score)."""
    dim = row["dim"]
    q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    qs, rows = _matrix(row["q_rows"], dim, row["q_n"]), _matrix(row["rows"], dim, row["n"])
    q_norms = np.sqrt((qs.astype(np.float64) ** 2).sum(1))
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    bounds = np.frombuffer(row["bounds"], np.float64) if row.get("bounds") else np.full(len(qs), -np.inf)
    picked = [candidates(rows, norms, q, qn, b) for q, qn, b in zip(qs, q_norms, bounds, strict=True)]
    top = float(q_norms.max(initial=0) * norms.max(initial=0))
    # queries that keep most of the bucket are verified together by one matrix product
    many = np.array([2 * len(p) > len(rows) for p in picked], dtype=bool)
    block = _products(rows, qs[many].T, top) if many.any() else None
    column = np.cumsum(many) - 1
    for i, pick in enumerate(picked):
        if not len(pick):
            continue
        scores = block[pick, column[i]] if many[i] else _products(rows[pick], qs[i], top)
        ok = (ids[pick] != q_ids[i]) & (scores >= bounds[i])
        scores, found = scores[ok], ids[pick][ok]
        for at in _best(scores, found, k):
            yield int(q_ids[i]), int(found[at]), int(scores[at])


def top_k(ints: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best rows of ``ints`` for each
    row of ``queries`` (both as :func:`integers` gives them)."""
    buckets = _blocked(ints, BUCKET_ROWS, "norm-buckets")
    blocks = _blocked(queries, QUERY_ROWS, "query-blocks").selectExpr(
        "block as q_block", "dim as q_dim", "n as q_n", "longest as q_longest", "shortest as q_shortest", "ids as q_ids", "rows as q_rows")

    # first bounds from the longest bucket of each dimension, copied to SALTS keys so that no key is hot
    longest = buckets.groupBy("dim").agg(F.max(F.struct("longest", "block")).alias("top")).select("top.block")
    # rows hold whole blocks and copies of them, so no join may collect one side on the driver for a broadcast
    first = buckets.hint("merge").join(longest, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("q_block"), F.lit(SALTS)).cast("int"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds = np.full(row["q_n"], -np.inf)
                if row["n"] is not None:
                    at = {q: i for i, q in enumerate(np.frombuffer(row["q_ids"], np.int64).tolist())}
                    seen: dict[int, list[int]] = {}
                    for q, _, s in _pair(row, k):
                        seen.setdefault(q, []).append(s)
                    for q, scores in seen.items():
                        if len(scores) == k:
                            bounds[at[q]] = min(scores)
                norms = np.sqrt((_matrix(row["q_rows"], row["q_dim"], row["q_n"]).astype(np.float64) ** 2).sum(1))
                # a bucket whose longest vector is shorter than this cannot matter to any query of the block
                need = float((bounds / np.where(norms > 0, norms, 1)).min(initial=np.inf))
                yield pa.RecordBatch.from_pylist(
                    [{"q_block": row["q_block"], "q_dim": row["q_dim"], "q_n": row["q_n"], "q_ids": row["q_ids"],
                      "q_rows": row["q_rows"], "bounds": bounds.tobytes(), "need": need}], schema=bound_schema)

    bound_schema = pa.schema([("q_block", pa.int64()), ("q_dim", pa.int32()), ("q_n", pa.int32()), ("q_ids", pa.binary()),
                              ("q_rows", pa.binary()), ("bounds", pa.binary()), ("need", pa.float64())])
    bounded = materialize(
        salted.hint("merge").join(first, (salted["q_dim"] == first["dim"]) & (salted["salt"] == first["salt"]), "left")
        .select("q_block", "q_dim", "q_n", "q_ids", "q_rows", "dim", "n", "ids", "rows")
        .mapInArrow(bound, "q_block long, q_dim int, q_n int, q_ids binary, q_rows binary, bounds binary, need double"), "query-bounds")

    down, across = (max(1, -(-t.count() // CELL_SIDE)) for t in (bounded, buckets))
    cells = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = bounded.withColumn("cell_q", cells("q_block", down)).withColumn("cell_b", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = buckets.withColumn("cell_b", cells("block", across)).withColumn("cell_q", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    pairs = left.hint("merge").join(right, ["cell_q", "cell_b"]).where("q_dim = dim and need <= longest * (1 + 1e-9)") \
        .select("q_block", "q_n", "q_ids", "q_rows", "bounds", "dim", "n", "ids", "rows")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = list(_pair(batch.slice(at, 1).to_pylist()[0], k))
                cols = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(verify, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
