"""Exact top-N by dot product without materialising (query, item) pairs.

Every recommendation list in the reference is "score every candidate, sort,
keep N".  Done with joins that is a pair set of |users| × |items|; here items
are dealt into blocks of a measured byte size and queries into blocks of rows,
and every (query block, item block) cell is one partition of a Spark shuffle:
the task holds the cell's items, streams its queries past them and reduces each
query to its N best before anything leaves the task.  Winners of the cells are
merged with a per-query window that Spark evaluates with a group limit.  Items
never pass through the driver, and one block or many is the same plan.

Ranking is on the score rounded to ``SCORE_DP`` decimals, ties by item
tie-break (ascending), so both engines of the oracle agree on the order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize_many

# The per-batch scoring functions below run in Python workers.  Pickle them by
# value so executors need no copy of this package on their path.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):   # older cloudpickle: ship the package instead
    pass

SCORE_DP = 6
# Items of one cell (bytes of their vectors and member lists), queries of one cell.
ITEM_BLOCK_BYTES = 64 * 1024 * 1024
QUERY_BLOCK_ROWS = 100_000
# Of sparse vectors, keys per matrix product (not a limit of the vocabulary),
# and bytes of the query rows scored at once.
MAX_DENSE_DIM = 2048
QUERY_CHUNK_BYTES = 32 * 1024 * 1024
# Ids of the lists that leave a task in one batch of rows.
LIST_BATCH_IDS = 1 << 20
# Of a top-N, query rows and items of one matrix product.
SCREEN_ROWS, SCREEN_ITEMS = 256, 2048


def top_n_per_key(df: DataFrame, key: str, score_col: str, tie_col: str, n: int,
                  rank_col: str = "rank") -> DataFrame:
    """W-03: ``row_number() ≤ n`` per key; planned with WindowGroupLimit, so
    each map task keeps only n rows per key before the shuffle (hot keys safe)."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(score_col, SCORE_DP)), F.asc(tie_col))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def to_sparse(long_df: DataFrame, id_col: str, key_col: str, weight_col: str) -> DataFrame:
    """Long ``(id, key, weight)`` → ``(id, keys array<string>, weights array<double>)``, for any
    number of keys; each id gathers its own entries only."""
    entry = F.struct(F.col(key_col).cast("string").alias("k"), F.col(weight_col).cast("double").alias("w"))
    return (long_df.where(F.col(key_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
            .select(id_col, F.col("_e.k").alias("keys"), F.col("_e.w").alias("weights")))


class _SparseBlock:
    """A block of sparse item vectors.  Scores are partial sums over its keys:
    keys that at least one item in eight has go through matrix products of
    ``MAX_DENSE_DIM`` keys (their matrix is at most eight times the entries),
    each other key adds to the pairs of query and item that both have it.  Products of a top-N also
    take the first ``near`` keys: those that one item in 64 has, while their matrix is
    at most two blocks' bytes.  Of a rarer key than one in eight the last entry of a row counts."""

    def __init__(self, keys: pa.ListArray, weights: pa.ListArray):
        flat = keys.flatten().dictionary_encode()
        vocab = np.array(flat.dictionary.to_pylist(), dtype=object)
        lens, weight = np.diff(keys.offsets.to_numpy()), weights.flatten().to_numpy().astype(np.float64)
        rows = np.repeat(np.arange(len(keys), dtype=np.int32), lens)
        place = np.argsort(vocab)                          # the same keys in the same order each run
        rank = np.empty_like(place)
        rank[place] = np.arange(len(place))
        code, vocab = rank[flat.indices.to_numpy()], vocab[place]
        count = np.bincount(code, minlength=len(vocab))
        often, common = count * 8 >= len(keys), count * 64 >= len(keys)
        place = np.argsort(~often * 1 + ~common, kind="stable")     # frequent keys first
        rank = np.empty_like(place)
        rank[place] = np.arange(len(place))
        code = rank[code]
        self.n, self.width, self.vocab = len(keys), int(often.sum()), list(vocab[place])
        self.index = pd.Index(self.vocab, dtype=object)
        self.near = max(self.width, min(int(common.sum()), 2 * ITEM_BLOCK_BYTES // (8 * max(len(keys), 1))))
        order = np.argsort(code, kind="stable")
        self.rows, self.weight = rows[order], weight[order]
        self.start = np.searchsorted(code[order], np.arange(len(vocab) + 1))
        self.slab = MAX_DENSE_DIM

    def matrix(self, width: int) -> np.ndarray:
        """The items' weights of the first ``width`` keys."""
        code = np.repeat(np.arange(width), np.diff(self.start[:width + 1]))
        return self._filled(self.n, width, self.rows[:len(code)], code, self.weight[:len(code)])

    def _filled(self, n: int, width: int, rows, code, weight) -> np.ndarray:
        out, upto = np.zeros((n, width)), code < self.width
        np.add.at(out, (rows[upto], code[upto]), weight[upto])
        out[rows[~upto], code[~upto]] = weight[~upto]
        return out

    def queries(self, keys: pa.ListArray, weights: pa.ListArray) -> np.ndarray:
        """The queries' weights of the block's keys."""
        lens = np.diff(keys.offsets.to_numpy())
        if not lens.sum():
            return np.zeros((len(keys), len(self.vocab)))
        flat = keys.flatten().dictionary_encode()
        code = self.index.get_indexer(np.array(flat.dictionary.to_pylist(), dtype=object))[flat.indices.to_numpy()]
        rows, weight, known = np.repeat(np.arange(len(keys)), lens), weights.flatten().to_numpy().astype(np.float64), code >= 0
        return self._filled(len(keys), len(self.vocab), rows[known], code[known], weight[known])

    def scorer(self):
        index = self.index
        dense = self.matrix(self.width)

        def score(keys: pa.ListArray, weights: pa.ListArray):
            lens = np.diff(keys.offsets.to_numpy())
            out = np.zeros((len(keys), self.n))
            if not lens.sum():
                return out
            flat = keys.flatten().dictionary_encode()
            code = index.get_indexer(np.array(flat.dictionary.to_pylist(), dtype=object))[flat.indices.to_numpy()]
            w = weights.flatten().to_numpy().astype(np.float64)
            q = np.repeat(np.arange(len(keys)), lens)
            for lo in range(0, self.width, self.slab):
                hi = min(lo + self.slab, self.width)
                use = (code >= lo) & (code < hi)
                part = np.zeros((len(keys), hi - lo))
                np.add.at(part, (q[use], code[use] - lo), w[use])
                out += part @ dense[:, lo:hi].T
            order = np.argsort(code, kind="stable")
            order = order[np.searchsorted(code[order], self.width):] if self.width else order[code[order] >= 0]
            for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
                lo, hi = self.start[code[own[0]]], self.start[code[own[0]] + 1]
                out[np.ix_(q[own], self.rows[lo:hi])] += np.outer(w[own], self.weight[lo:hi])
            return out
        return score


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix; an empty list is a row of zeros."""
    lens = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lens), int(lens.max(initial=0))))
    out[lens > 0] = lists.flatten().to_numpy().reshape(int((lens > 0).sum()), -1)
    return out


class _Items:
    """The items of one cell."""

    def __init__(self, batches: list[pa.RecordBatch], names: list[str]):
        """With lists, their rows come first (side -1)."""
        own = [b for b in batches if b.column("side")[0].as_py() == 0]
        col = lambda c, of=own: pa.concat_arrays([b.column(c) for b in of])
        self.ids, self.ties = col("id").to_numpy(), col("tie").to_numpy()
        self.dense = _matrix(col("vec")) if "vec" in names else None
        self.block = self.sparse = self.width = self.best = None
        if "keys" in names:
            self.block = _SparseBlock(col("keys"), col("weights"))
            self.width = min(self.block.width, self.block.slab)
        self.lists = None
        if "lists" in names:
            of = batches[:len(batches) - len(own)]
            at = np.searchsorted(self.ids, col("id", of).to_numpy()) if of else np.zeros(0, np.int64)
            self.lists = col("lists", of) if of else col("lists").slice(0, 0)
            self.n_lists = np.bincount(at, minlength=len(self.ids))
            self.first_list = np.cumsum(self.n_lists) - self.n_lists
        self.members = None
        if "members" in names:
            lists = col("members")
            lens = np.diff(lists.offsets.to_numpy())
            self.members = np.full((len(lens), max(1, int(lens.max(initial=0)))), -1, dtype=np.int64)
            self.members[np.arange(self.members.shape[1]) < lens[:, None]] = lists.flatten().to_numpy()

    def scores(self, queries: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((queries.num_rows, len(self.ids)))
        if self.dense is not None and self.dense.shape[1]:
            vec = _matrix(queries.column("vec"))
            if vec.shape[1]:
                out += vec @ self.dense.T
        if self.block is not None:
            self.sparse = self.sparse or self.block.scorer()
            out += self.sparse(queries.column("keys"), queries.column("weights"))
        return out


class _Best:
    """The best items of queries, in products of a few rows by a few items that stay in the
    processor's cache.  Items come in the order of their ties, so once a row has ``k`` items, another
    needs a higher rounded score; pairs below that bound are dropped by one comparison, and only the
    others are ranked."""

    def __init__(self, items: _Items):
        self.items, block, n = items, items.block, len(items.ids)
        near = ([items.dense] if items.dense is not None else []) + ([block.matrix(block.near)] if block else [])
        self.near = near[0] if len(near) == 1 else np.hstack([np.zeros((n, 0)), *near])
        self.rare = block is not None and block.near < len(block.vocab)
        self.tile = max(n, 1) if self.rare else SCREEN_ITEMS
        wide = max(len(block.vocab) if block else 0, n if self.rare else 0, 1)
        self.rows = max(1, min(SCREEN_ROWS, QUERY_CHUNK_BYTES // (8 * wide)))

    def _scores(self, queries: pa.RecordBatch):
        """Scores of the queries and a range of items; of the whole block where it has rare keys."""
        items, block, parts, rare = self.items, self.items.block, [], []
        if items.dense is not None:
            vec = _matrix(queries.column("vec"))
            parts.append(vec if vec.shape[1] else np.zeros((len(vec), items.dense.shape[1])))
        if block:
            own = block.queries(queries.column("keys"), queries.column("weights"))
            parts.append(own[:, :block.near])
            code, q = np.nonzero(own[:, block.near:].T)
            rare = [(code[at[0]] + block.near, q[at]) for at in np.split(np.arange(len(q)), np.flatnonzero(np.diff(code)) + 1) if len(at)]
        near = np.hstack([np.zeros((queries.num_rows, 0)), *parts])

        room = np.empty(len(near) * min(self.tile, len(items.ids)))      # one for all products

        def scores(lo: int, hi: int) -> np.ndarray:
            s = np.matmul(near, self.near[lo:hi].T, out=room[:len(near) * (hi - lo)].reshape(len(near), hi - lo))
            for code, rows in rare:
                at = slice(block.start[code], block.start[code + 1])
                s[np.ix_(rows, block.rows[at])] += np.outer(own[rows, code], block.weight[at])
            return s
        return scores

    def __call__(self, queries: pa.RecordBatch, k: int, positive_only: bool, exclude_self: bool):
        """Rows, columns, scores and rounded scores of the ``k`` best pairs of each query."""
        items, m, n = self.items, queries.num_rows, len(self.items.ids)
        qids = queries.column("q").to_numpy(zero_copy_only=False)
        scores, want, unit = self._scores(queries), k + exclude_self, 10.0 ** -SCORE_DP
        bound = np.full(m, 5e-324 if positive_only else -np.inf)     # the least number above zero
        held, found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []

        def ranked():
            rows, cols, s = map(np.concatenate, zip(held, *found, strict=True))
            keep = _first_k_per_row(rows, (items.ties[cols], -np.round(s, SCORE_DP)), k) if len(rows) else rows
            return rows[keep], cols[keep], s[keep]

        for lo in range(0, n, self.tile):
            s = scores(lo, min(lo + self.tile, n))
            # a cell of at most k items keeps all valid ones
            over = s >= bound[:, None] if n > k or positive_only else np.ones(s.shape, bool)
            if s.shape[1] > want and np.count_nonzero(over) > 4 * want * m:
                kth = np.partition(s, s.shape[1] - want, axis=1)[:, s.shape[1] - want]
                np.fmax(bound, kth - unit - 4e-15 * np.abs(kth), out=bound)
                over = s >= bound[:, None]
            at = np.flatnonzero(over)
            if not len(at):
                continue
            rows, cols, s = at // s.shape[1], at % s.shape[1] + lo, s.reshape(-1)[at]
            if exclude_self:
                other = items.ids[cols] != qids[rows]
                rows, cols, s = rows[other], cols[other], s[other]
            found.append((rows, cols, s))
            if lo + self.tile < n and len(held[0]) + sum(len(f[0]) for f in found) > 2 * k * m:
                held, found = ranked(), []
                rows, last = held[0], np.flatnonzero(np.diff(held[0], append=m))     # the last of each row
                last = last[np.bincount(rows, minlength=m)[rows[last]] == k]
                least = np.round(held[2][last], SCORE_DP)
                bound[rows[last]] = np.fmax(bound[rows[last]], least + unit / 4 - 4e-15 * np.abs(least))
        rows, cols, s = ranked()
        return rows, cols, s, np.round(s, SCORE_DP)


def _score_cells(names: list[str], k: int | None, positive_only: bool, exclude_self: bool, keep: int | None):
    """Rows sorted by (cell, side, tie): the items of a cell, then its queries."""

    drop_self = lambda items: exclude_self and items.members is None

    def ranked(items, queries):
        """Chunks of the queries with their pairs."""
        items.best = items.best or _Best(items)
        for at in range(0, queries.num_rows, items.best.rows):
            chunk = queries.slice(at, items.best.rows)
            yield chunk, *items.best(chunk, k, positive_only, drop_self(items))

    def scored(items, queries):
        step = max(1, QUERY_CHUNK_BYTES // (8 * max(len(items.ids), items.width or 0, 1)))
        for at in range(0, queries.num_rows, step):
            chunk = queries.slice(at, step)
            s = items.scores(chunk)
            r = np.round(s, SCORE_DP)
            qids = chunk.column("q").to_numpy(zero_copy_only=False)
            rows, cols = _pick(s, r, qids, items.ids, items.ties, k, positive_only, drop_self(items))
            yield chunk, rows, cols, s[rows, cols], r[rows, cols]

    def best(items, queries):
        for chunk, rows, cols, s, r in (scored if k is None else ranked)(items, queries):
            qids = chunk.column("q").to_numpy(zero_copy_only=False)
            if not rows.size:
                continue
            if items.lists is not None:
                yield from _with_lists(chunk.column("q"), rows, cols, s, items)
                continue
            if items.members is None:
                found = [qids[rows]], [items.ids[cols]], [s], [items.ties[cols]]
            else:
                found = [], [], [], []
                _expand(rows, cols, s, r, qids, items.members, keep, exclude_self, *found)
            q, i, score, tie = (x[0] for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(q, queries.schema.field("q").type), pa.array(i), pa.array(score), pa.array(tie)],
                                             names=["q", "item_id", "score", "_tie"])

    def run(batches):
        cell, held, items = None, [], None
        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells) | np.diff(sides)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if cells[lo] != cell:
                    cell, held, items = cells[lo], [], None
                if sides[lo] <= 0:
                    held.append(part)
                elif held or items:
                    if items is None:
                        items, held = _Items(held, names), []
                    yield from best(items, part)

    return run


def _with_lists(queries: pa.Array, rows, cols, s, items: _Items):
    """Pairs with each list of their item, about ``LIST_BATCH_IDS`` ids in a batch."""
    n = items.n_lists[cols]
    of = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.first_list[cols], n)
    rows, s = np.repeat(rows, n), np.repeat(s, n)
    upto = np.cumsum(np.diff(items.lists.offsets.to_numpy())[of])
    cuts = [0, *(np.flatnonzero(np.diff(upto // LIST_BATCH_IDS)) + 1), len(rows)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield pa.RecordBatch.from_arrays([queries.take(pa.array(rows[lo:hi])), pa.array(s[lo:hi]), items.lists.take(pa.array(of[lo:hi]))],
                                         names=["q", "score", "lists"])


def _first_k_per_row(rows, keys, k):
    """Indices ordering by (row, *keys reversed by lexsort) keeping k per row."""
    order = np.lexsort(tuple(keys) + (rows,))
    srows = rows[order]
    first = np.r_[0, np.flatnonzero(np.diff(srows)) + 1]
    rank = np.arange(srows.size) - np.repeat(first, np.diff(np.r_[first, srows.size]))
    return order[rank < k]


def _pick(s, r, qids, ids, ties, k, positive_only, exclude_self):
    """Vectorised over a chunk of query rows: valid candidates, then the k best
    per row by (rounded score desc, tie asc).  Rows are cut at the k-th best
    rounded score first (ties kept), then ordered exactly and ranked."""
    valid = np.ones(s.shape, dtype=bool)
    if positive_only:
        valid &= s > 0
    if exclude_self:
        valid &= ids[None, :] != qids[:, None]
    if k is not None and s.shape[1] > k:
        rr = np.where(valid, r, -np.inf)
        kth = -np.partition(-rr, k - 1, axis=1)[:, k - 1]
        valid &= rr >= kth[:, None]
    rows, cols = np.nonzero(valid)
    if rows.size and k is not None:
        keep = _first_k_per_row(rows, (ties[cols], -r[rows, cols]), k)
        rows, cols = rows[keep], cols[keep]
    return rows, cols


def _expand(rows, cols, s, r, qids, mem, k, exclude_self, out_q, out_i, out_s, out_t):
    """Candidates are groups (signatures) of items sharing one score: expand
    each picked group to its member ids (padded matrix, -1 = empty), drop the
    query's own id when asked, and keep the k best items per query row by
    (rounded score desc, item id asc)."""
    mm = mem[cols]
    mask = mm >= 0
    if exclude_self:
        mask &= mm != qids[rows][:, None]
    lens = mask.sum(axis=1)
    rows2 = np.repeat(rows, lens)
    ids2 = mm[mask]
    s2 = np.repeat(s, lens)
    r2 = np.repeat(r, lens)
    if k is not None and rows2.size:
        keep = _first_k_per_row(rows2, (ids2, -r2), k)
        rows2, ids2, s2 = rows2[keep], ids2[keep], s2[keep]
    out_q.append(qids[rows2])
    out_i.append(ids2)
    out_s.append(s2)
    out_t.append(ids2)


def topk_dot(queries: DataFrame, q_id: str, items: DataFrame, i_id: str, tie: str, k: int | None,
             positive_only: bool = False, exclude_self: bool = False,
             members: str | None = None, keep: int | None = None) -> DataFrame:
    """Top ``k`` items per query by ``queries.vec · items.vec``.

    ``queries``: ``(q_id, vec)``; ``items``: ``(i_id, tie, vec)`` with the same
    vector length, or both with ``keys`` and ``weights`` of :func:`to_sparse`
    instead (any number of keys), or with all three: the score is the sum of both
    products.  A null vector is a row of zeros.  Returns ``(q_id, item_id, score, rank)``;
    with ``k=None`` every (valid) candidate is returned, unranked.

    With ``members`` (an ``array<bigint>`` column of ascending ids, at most
    ``k`` per item) each candidate stands for a group of items sharing its
    vector: the k best groups per query (by score desc, ``tie`` asc) are
    expanded inside the task and the result is the ``keep`` (default k) best
    *member* ids, ties by id, so no join is needed to expand groups; there
    ``exclude_self`` compares the query id with member ids.
    """
    keep = k if keep is None else keep
    spark = queries.sparkSession
    q_type = dict(queries.dtypes)[q_id]
    kinds = {"vec": "array<double>", "keys": "array<string>", "weights": "array<double>", "members": "array<bigint>"}
    names = [c for c in ("vec", "keys", "weights") if c in items.columns]
    filled = lambda c: F.coalesce(F.col(c).cast(kinds[c]), F.array().cast(kinds[c])).alias(c)
    own = [F.coalesce(F.col(members).cast(kinds["members"]), F.array().cast(kinds["members"])).alias("members")] if members else []
    queries, items = materialize_many([
        (queries.select(F.col(q_id).alias("q"), *map(filled, names)), "topk-queries"),
        (items.select(F.col(i_id).cast("bigint").alias("id"), F.col(tie).cast("bigint").alias("tie"), *map(filled, names), *own), "topk-items")])
    names += ["members"] if members else []

    # two numbers reach the driver: the bytes of the item side and the number of queries
    per_item = sum(((24 if c == "keys" else 8) * F.size(c) for c in names), F.lit(16))
    n_items = max(1, -(-(items.agg(F.sum(per_item)).first()[0] or 0) // ITEM_BLOCK_BYTES))
    n_parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_queries = max(-(-n_parts // n_items), -(-queries.count() // QUERY_BLOCK_ROWS))

    def block(col: str, n: int):
        return F.pmod(F.xxhash64(col), F.lit(n))

    def cell(item_block, query_block):
        return (item_block * n_queries + query_block).cast("int").alias("cell")

    absent = lambda c, kind: F.lit(None).cast(kind).alias(c)
    as_items = items.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).select(
        cell(block("id", n_items), F.col("qb")), F.lit(0).alias("side"), absent("q", q_type), "id", "tie", *names)
    as_queries = queries.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1)))).select(
        cell(F.col("ib"), block("q", n_queries)), F.lit(1).alias("side"), "q", absent("id", "bigint"), absent("tie", "bigint"),
        *(c if c != "members" else absent(c, kinds[c]) for c in names))
    merged = (as_items.unionByName(as_queries).repartitionById(n_items * n_queries, F.col("cell"))
              .sortWithinPartitions("cell", "side", "tie")
              .mapInArrow(_score_cells(names, k, positive_only, exclude_self, keep), f"q {q_type}, item_id bigint, score double, _tie bigint")
              .withColumnRenamed("q", q_id))
    if k is None:
        return merged.drop("_tie")
    return top_n_per_key(merged, q_id, "score", "_tie", keep if members else k).drop("_tie")


def dot_lists(queries: DataFrame, q_id: str, items: DataFrame, i_id: str, lists: DataFrame) -> DataFrame:
    """Positive dot products of sparse vectors (:func:`to_sparse`) as ``(q_id, score, members)``: a row per
    query and list of the item, of ``lists`` ``(i_id, part, members)``.

    The lists go into the cells beside their items and leave the scoring task with the scores, so no
    row per pair is shuffled or kept on disk.  Items are dealt into blocks as in :func:`topk_dot`; the lists of a
    block are dealt once more, so that the copies of lists (one per query block) and of queries (one
    per block of lists) take the least together."""
    spark = queries.sparkSession
    q_type, l_type = dict(queries.dtypes)[q_id], dict(lists.dtypes)["members"]
    filled = lambda c, t: F.coalesce(F.col(c).cast(t), F.array().cast(t)).alias(c)
    vector = filled("keys", "array<string>"), filled("weights", "array<double>")
    queries, items, lists = materialize_many([
        (queries.select(F.col(q_id).alias("q"), *vector), "topk-queries"),
        (items.select(F.col(i_id).cast("bigint").alias("id"), *vector), "topk-items"),
        (lists.select(F.col(i_id).cast("bigint").alias("id"), "part", F.col("members").alias("lists")), "topk-lists")])
    lists = lists.join(items.select("id"), "id", "left_semi")      # of items with a vector

    # four numbers reach the driver
    size = F.sum(24 * F.size("keys") + 8 * F.size("weights") + 16)
    of_items, of_lists = items.agg(size).first()[0] or 0, lists.agg(F.sum(8 * F.size("lists") + 16)).first()[0] or 0
    of_queries, n = queries.agg(size, F.count(F.lit(1))).first()
    n_parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_items = max(1, -(-of_items // ITEM_BLOCK_BYTES))
    n_lists = max(1, -(-of_lists // (n_items * ITEM_BLOCK_BYTES)), min(n_parts, round((n_parts * of_lists / max(1, of_queries or 0)) ** 0.5)) // n_items)
    n_queries = max(-(-n_parts // (n_items * n_lists)), -(-n // QUERY_BLOCK_ROWS))

    def block(count: int, *cols: str):
        return F.pmod(F.xxhash64(*cols), F.lit(count))

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def rows(df: DataFrame, side: int, item_block, list_block, query_block) -> DataFrame:
        kinds = {"q": q_type, "id": "bigint", "tie": "bigint", "keys": "array<string>", "weights": "array<double>", "lists": l_type}
        for name, value in (("_i", item_block), ("_l", list_block), ("_q", query_block)):     # one generator a step
            df = df.withColumn(name, value)
        given = {**{c: F.col(c) for c in df.columns}, **({"tie": F.col("id")} if "id" in df.columns else {})}
        return df.select((((F.col("_i") * n_lists + F.col("_l")) * n_queries) + F.col("_q")).cast("int").alias("cell"), F.lit(side).alias("side"),
                         *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    dealt = rows(lists, -1, block(n_items, "id"), block(n_lists, "id", "part"), each(n_queries)) \
        .unionByName(rows(items, 0, block(n_items, "id"), each(n_lists), each(n_queries))) \
        .unionByName(rows(queries, 1, each(n_items), each(n_lists), block(n_queries, "q")))
    return (dealt.repartitionById(n_items * n_lists * n_queries, F.col("cell")).sortWithinPartitions("cell", "side", "tie")
            .mapInArrow(_score_cells(["keys", "weights", "lists"], None, True, False, None), f"q {q_type}, score double, lists {l_type}")
            .select(F.col("q").alias(q_id), "score", F.col("lists").alias("members")))


def pair_dot(pairs: DataFrame, left: DataFrame, left_id: str, right: DataFrame, right_id: str, key: str,
             value: str = "value", out: str = "score") -> DataFrame:
    """Dot products of requested (``left_id``, ``right_id``) pairs alone, from sparse vectors in
    long form ``(id, key, value)`` with one row per id and key.

    Each vector becomes one array sorted by key, and a pair's two arrays are merged in a
    column expression, so no step has more rows than there are distinct pairs.  The arrays
    (of ids that a pair names) are written first: both joins are between plain
    shuffles, which AQE splits where one id is in very many pairs.  Pairs whose
    vectors share no key, or that lack one, have no row.
    """
    wanted = pairs.select(left_id, right_id).where(f"{left_id} is not null and {right_id} is not null").distinct()

    def arrays(df, id_col, name):
        entry = F.struct(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
        return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()) \
            .join(pairs.select(id_col).distinct(), id_col, "left_semi") \
            .groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias(name))

    wanted, lefts, rights = materialize_many([(wanted, "pairs"), (arrays(left, left_id, "_l"), "pair-left"),
                                              (arrays(right, right_id, "_r"), "pair-right")])
    none = F.lit(None).cast("double")
    merged = F.aggregate(
        # two sorted runs, which the sort merges; a key is in each at most once
        F.sort_array(F.concat("_l", "_r")),
        F.struct(F.lit(None).cast(left.schema[key].dataType).alias("k"), none.alias("v"), none.alias("s")),
        lambda a, x: F.struct(x["k"].alias("k"), x["v"].alias("v"), F.when(
            a["k"] == x["k"], F.coalesce(a["s"], F.lit(0.0)) + a["v"] * x["v"]).otherwise(a["s"]).alias("s")),
        lambda a: a["s"])
    return wanted.join(rights, right_id).join(lefts, left_id).select(left_id, right_id, merged.alias(out)).where(F.col(out).isNotNull())
