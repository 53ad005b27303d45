"""Collaborative filtering (P-20, A-08, M-05, M-06, M-07, J-14).

Stored factors are long form ``(id, dim, value)``, keyed by the real ids (the
reference recomputed codes per chunk, D-02).  Updates work on one array per id,
so a rating cell is one row of a join, whatever the number of dimensions, and
the sums over cells are vector-valued partial aggregates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import seeded_uniform, seeded_uniform_text
from ..session import ensure_checkpoint_dir, materialize, materialize_many
from . import fold
from .ordering import ordered_index

# Latent dimensions, regularisation λ, learning rate η, seed,
# initial spread, training batch size (rows per time slice).
N_COMPONENTS = 50
REGULARIZATION = 0.01
LEARNING_RATE = 0.1
SEED = 42
INIT_STD = 0.1
BATCH_ROWS = 10000


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """P-20: sorted distinct values → 0-based dense codes (global, distributed)."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    return ordered_index(distinct, [col], "code")


def user_item_matrix(ratings: DataFrame) -> DataFrame:
    """A-08: (user, movie) cells, duplicate ratings summed."""
    return (ratings.where(F.col("rating").isNotNull())
            .groupBy("user_id", "movie_id").agg(F.sum("rating").cast("double").alias("r")))


def _uniform(id_col: str, salt: int, seed: int):
    """Uniform (0, 1) per (id, dim): engine-neutral seeded draw."""
    return seeded_uniform(F.col(id_col), F.col("dim"), seed, salt)


def factor_init(ids: DataFrame, id_col: str, k: int = N_COMPONENTS, seed: int = SEED,
                std: float = INIT_STD) -> DataFrame:
    """M-05: normal(0, std) factors, one value per (id, dim), drawn by Box–Muller
    from a deterministic function of (id, dim, seed): the same at any
    partitioning or scale, and on a task retry."""
    base = ids.select(id_col).distinct().select(id_col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("dim"))
    z = F.sqrt(-2.0 * F.log(_uniform(id_col, 1, seed))) * F.cos(2.0 * math.pi * _uniform(id_col, 2, seed))
    return base.select(id_col, "dim", (z * std).alias("value"))


def to_vectors(long_f: DataFrame, id_col: str, k: int = N_COMPONENTS) -> DataFrame:
    """Long form → ``(id, vec)``, the dims 0 … k-1 as an array (null where a dim has no row)."""
    dims = ", ".join(f"max(case when dim = {d} then value end)" for d in range(k))
    return long_f.groupBy(id_col).agg(F.expr(f"array({dims})").alias("vec"))


def to_long(vectors: DataFrame, id_col: str) -> DataFrame:
    """``(id, vec)`` → long form."""
    return vectors.select(id_col, F.posexplode("vec").alias("dim", "value")).where(F.col("value").isNotNull())


def init_vectors(ids: DataFrame, id_col: str, k: int = N_COMPONENTS, seed: int = SEED, std: float = INIT_STD) -> DataFrame:
    """:func:`factor_init` as one array per id."""
    return ids.select(id_col).distinct().select(id_col, init_vector(id_col, k, seed, std).alias("vec"))


def init_vector(id_col: str, k: int = N_COMPONENTS, seed: int = SEED, std: float = INIT_STD):
    """The initial vector of an id."""
    def draw(dim):
        u1, u2 = (seeded_uniform(F.col(id_col), dim, seed, salt) for salt in (1, 2))
        return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2) * std

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), draw)


def init_values(id_col: str, dims, seed: int = SEED, std: float = INIT_STD):
    """Some values of :func:`init_vector`, as one compiled expression."""
    def draw(dim: int) -> str:
        u1, u2 = (seeded_uniform_text(id_col, dim, seed, salt) for salt in (1, 2))
        return f"sqrt(-2.0D * ln({u1})) * cos({2.0 * math.pi!r}D * {u2}) * {std!r}D"

    return F.expr(f"array({', '.join(map(draw, dims))})")


def _weighted_sum(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``s`` per key: the vectors of its rows times ``c · r``, summed.  One row of k sums per key and
    map task is shuffled, so neither the dimensions nor a hot key multiply the rows."""
    sums = ", ".join(f"sum(w * vec[{d}])" for d in range(k))
    return rows.select(key, (F.col("c") * F.col("r")).alias("w"), "vec").groupBy(key).agg(F.expr(f"array({sums})").alias("s"))


def _moved(old, s, decay: float, lr: float):
    both = F.zip_with(old, s, lambda o, n: F.when(o.isNull(), n).when(n.isNull(), o).otherwise(decay * o + lr * n))
    return F.when(old.isNull(), s).when(s.isNull(), old).otherwise(both)


def update_vectors(batch: DataFrame, users: DataFrame, items: DataFrame, k: int = N_COMPONENTS, reg: float = REGULARIZATION,
                   lr: float = LEARNING_RATE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """M-06 on ``(user_id, vec)`` and ``(movie_id, vec)``: the rows that the batch changes or adds.

    The batch's own items (then users) are written with their counts first, so the joins with the
    cells are between plain shuffles, which AQE splits for an id that very many cells share."""
    rated = batch.where(F.col("rating").isNotNull())
    cells = materialize(user_item_matrix(rated), "batch-cells")
    c_item = rated.groupBy("movie_id").agg(F.count(F.lit(1)).cast("double").alias("c"))
    c_user = rated.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("c"))
    decay = 1.0 - lr * reg

    new_items = c_item.select("movie_id").join(items.select("movie_id"), "movie_id", "left_anti")
    own_items = materialize(items.unionByName(init_vectors(new_items, "movie_id", k, seed)).join(c_item, "movie_id"), "batch-items")
    u_sum = _weighted_sum(cells.join(own_items, "movie_id"), "user_id", k)
    changed_users = u_sum.join(users, "user_id", "left").select("user_id", _moved(F.col("vec"), F.col("s"), decay, lr).alias("vec"))
    changed_users = materialize(changed_users.join(c_user, "user_id"), "batch-users")

    i_sum = _weighted_sum(cells.join(changed_users, "user_id"), "movie_id", k)
    changed_items = own_items.join(i_sum, "movie_id").select("movie_id", _moved(F.col("vec"), F.col("s"), decay, lr).alias("vec"))
    return changed_users.drop("c"), changed_items


def latest(old: DataFrame, changed: DataFrame, id_col: str) -> DataFrame:
    """``old`` with the rows of ``changed`` in place of those with the same id, and its new ids."""
    return old.join(changed.select(id_col), id_col, "left_anti").unionByName(changed)


def factor_update(batch: DataFrame, user_f: DataFrame, item_f: DataFrame, k: int = N_COMPONENTS,
                  reg: float = REGULARIZATION, lr: float = LEARNING_RATE, seed: int = SEED):
    """M-06: one incremental update on a batch of ratings (equations of the
    blueprint §2.13).  ``c_i``/``c_u`` count the batch's rating rows per item /
    user; cells are summed duplicates.  Existing users decay and move towards
    ``Σ_i c_i R_ui V_i``; new users start at that sum; then items (new items
    first get initial factors) move towards ``Σ_u c_u R_ui U'_u``.

    Takes and returns long form with the dims 0 … k-1: ``(user factors, item
    factors)`` including untouched ids.
    """
    users, items = materialize_many([(to_vectors(user_f, "user_id", k), "user-vectors"), (to_vectors(item_f, "movie_id", k), "item-vectors")])
    changed_users, changed_items = update_vectors(batch, users, items, k, reg, lr, seed)
    return (to_long(latest(users, changed_users, "user_id"), "user_id"),
            to_long(latest(items, materialize(changed_items, "changed-items"), "movie_id"), "movie_id"))


# Rated rows whose cells are one file (its rows are sorted by slice in one task), and the most files.
PART_ROWS = 4_000_000
MAX_PARTS = 64


def cf_train_incremental(ratings: DataFrame, order: list[str], batch_rows: int = BATCH_ROWS,
                         k: int = N_COMPONENTS, seed: int = SEED, skip_first: bool = False, compact_every: int | None = None):
    """M-07 option: fold the update over time-ordered slices of
    ``batch_rows`` ratings.  The first slice initialises factors (and with
    ``skip_first`` is not learned from, as in the reference, D-03).

    No dimension of a factor depends on another one, so the slices are run by tasks that hold a few
    dimensions of all factors each (:mod:`.fold`), and the number of jobs does not grow with that of
    the slices.  Cells are written once, in the order of their slices, and read by every task.  Only ids that get factors are coded: those of the first
    slice and those of a cell with both ids.  (``compact_every`` is of no effect: no versions are kept.)
    """
    spark = ratings.sparkSession
    ensure_checkpoint_dir(spark)
    rated = ratings.where(F.col("rating").isNotNull())
    own = ["user_id", "movie_id", "rating"]
    indexed = ordered_index(rated.select(*dict.fromkeys(own + list(order))), order, "_pos", keep=own) \
        .withColumn("slice", F.floor(F.col("_pos") / batch_rows))
    n_slices, n_rated = indexed.agg(F.max("slice") + 1, F.count(F.lit(1))).first()
    n_parts = max(1, min(n_slices or 0, -(-n_rated // PART_ROWS), MAX_PARTS))
    users, movies = _codes(indexed, "user_id"), _codes(indexed, "movie_id")

    def code(of: DataFrame, id_col: str, name: str) -> DataFrame:
        return of.select(id_col, F.col("code").alias(name)).hint("shuffle_hash")

    coded = indexed.where(F.col("slice") >= int(skip_first)) \
        .join(code(users, "user_id", "user"), "user_id", "left").join(code(movies, "movie_id", "movie"), "movie_id", "left") \
        .select("slice", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("user", "movie")), F.col("rating").cast("double").alias("rating"))
    part = F.floor(F.col("slice") / -(-(n_slices or 1) // n_parts)).cast("int")
    cells = materialize(coded.repartitionById(n_parts, part).sortWithinPartitions("slice").mapInArrow(fold.cells_of, fold.CELLS), "cells")
    # a file holds a range of slices in their order, and files are named by the number of their partition
    files = sorted(cells.inputFiles(), key=lambda f: f.rsplit("/", 1)[-1])

    n_users, n_movies = users.count(), movies.count()
    width = max(1, min(-(-k // max(1, spark.sparkContext.defaultParallelism)), fold.STATE_BYTES // (8 * max(1, n_users + n_movies))))
    types = {c: dict(rated.dtypes)[c] for c in ("user_id", "movie_id")}

    columns = {"slice": "long", **types, "code": "long", "vec": "array<double>", "cells": "binary"}

    def rows(df: DataFrame, **given) -> DataFrame:
        return df.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()))

    def named(of: DataFrame, id_col: str, kind: int, dims: range) -> DataFrame:
        return rows(of, slice=F.lit(kind), code=F.col("code"), vec=F.when(F.col("initial"), init_values(id_col, dims, seed)), **{id_col: F.col(id_col)})

    def learned(first: int) -> DataFrame:
        last = min(first + width, k)
        before = [named(users, "user_id", fold.USERS, range(first, last)),
                  named(movies.withColumn("initial", F.lit(True)), "movie_id", fold.MOVIES, range(first, last))]
        in_order = [rows(spark.read.schema(fold.CELLS).parquet(f), slice=F.col("slice"), cells=F.col("cells")) for f in files]
        run = fold.learner(last - first, n_users, n_movies, first, 1.0 - LEARNING_RATE * REGULARIZATION, LEARNING_RATE)
        schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", first int, vec array<double>"
        return reduce(DataFrame.unionByName, before + in_order).coalesce(1).mapInArrow(run, schema)

    factors = reduce(DataFrame.unionByName, materialize_many([(learned(first), "factors") for first in range(0, k, width)]))
    return tuple(factors.where(F.col(c).isNotNull()).select(c, "first", F.posexplode("vec").alias("at", "value"))
                 .select(c, (F.col("first") + F.col("at")).alias("dim"), "value") for c in ("user_id", "movie_id"))


def _codes(indexed: DataFrame, id_col: str) -> DataFrame:
    """``(id, code, initial)`` of the ids that the fold gives factors to; ``initial``: it is in the first slice."""
    zero, full = F.col("slice") == 0, F.col("user_id").isNotNull() & F.col("movie_id").isNotNull()
    ids = indexed.where(F.col(id_col).isNotNull() & (zero | full)).groupBy(id_col).agg(F.max(zero).alias("initial"))
    return materialize(ordered_index(ids, [id_col], "code"), "codes")


def cf_train_als(ratings: DataFrame, rank: int = N_COMPONENTS, seed: int = SEED, max_iter: int = 10,
                 reg: float = REGULARIZATION):
    """M-07 default: ``pyspark.ml`` ALS on summed (user, movie) cells; cold-start
    rows are dropped at prediction time.  MLlib wants 32-bit ids, so both ids
    go in as dense codes (:func:`category_codes`); returns ``(model, user
    codes (user_id, code), movie codes (movie_id, code))``.

    Factors are checkpointed in every iteration, after which MLlib drops the shuffle files of the
    one before: disk holds those of one iteration, not of all."""
    from pyspark.ml.recommendation import ALS

    ensure_checkpoint_dir(ratings.sparkSession)
    cells = materialize(user_item_matrix(ratings), "cells")  # read three times below
    users, movies = (materialize(category_codes(cells, c), "codes") for c in ("user_id", "movie_id"))
    coded = cells.join(users.select("user_id", F.col("code").alias("user")), "user_id") \
        .join(movies.select("movie_id", F.col("code").alias("item")), "movie_id").select("user", "item", "r")
    als = ALS(rank=rank, seed=seed, maxIter=max_iter, regParam=reg, userCol="user", itemCol="item",
              ratingCol="r", coldStartStrategy="drop", nonnegative=False, checkpointInterval=1)
    return als.fit(coded), users, movies


def cf_scores(pairs: DataFrame, user_f: DataFrame, item_f: DataFrame) -> DataFrame:
    """J-14: ``U_u · V_m`` for requested (user, movie) pairs; pairs lacking
    either side get no score."""
    from . import scoring

    return scoring.pair_dot(pairs, user_f, "user_id", item_f, "movie_id", "dim", out="cf_score")


def model_factors_long(model, users: DataFrame, movies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ALS model factor arrays → long form ``(id, dim, value)`` under the real ids."""
    def named(factors, codes, id_col):
        return factors.join(codes.withColumnRenamed("code", "id"), "id").select(
            id_col, F.posexplode("features").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))

    return named(model.userFactors, users, "user_id"), named(model.itemFactors, movies, "movie_id")
