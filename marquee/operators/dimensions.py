"""Dimension maintenance, set-based (J-05, J-06, J-07, J-12, K-03).

The reference resolved keys one row at a time against the database; here each
step is a join: new keys are a distinct anti-join, ids for new keys come from a
distributed ordered index, and facts are resolved with an equi-join that
Spark turns into a broadcast join only when the dimension is measured small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import ordered_index

# Fixed value: title id given to a movie created from a bare movie id (D-08).
PLACEHOLDER_PREFIX = "unknown+"


def _max_id(dim: DataFrame, id_col: str) -> int:
    row = dim.agg(F.max(id_col).alias("m")).first()  # one-row aggregate
    return int(row["m"]) if row and row["m"] is not None else 0


def new_movie_keys(facts: DataFrame, movies: DataFrame, title_col: str = "movie_title_id") -> DataFrame:
    """J-05 part 1: titles referenced by facts that the dimension lacks, with
    fresh surrogate ids ``max(id) + 1 …`` in title order (repeatable on replay)."""
    missing = (facts.select(F.col(title_col).alias("movie_title_id")).where("movie_title_id is not null")
               .distinct()
               .join(movies.select("movie_title_id"), "movie_title_id", "left_anti"))
    return numbered_titles(missing, _max_id(movies, "movie_id"))


def numbered_titles(missing: DataFrame, base: int) -> DataFrame:
    """Distinct titles with the ids ``base + 1 …`` in title order."""
    return (ordered_index(missing, ["movie_title_id"], "_i")
            .select((F.lit(base) + 1 + F.col("_i")).cast("bigint").alias("movie_id"), "movie_title_id"))


def batch_movie_keys(titles: DataFrame, movies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-05 for a batch: ``(keys of its titles, new movie rows)``, both written.  ``titles`` are read
    three times and the dimension twice, once as the side that is not sent to the tasks where the
    batch's titles are the fewer; facts then meet the batch's own keys, not the whole dimension."""
    seen = materialize(titles.select("movie_title_id").where("movie_title_id is not null").distinct(), "batch-titles")
    found = materialize(movies.select("movie_id", "movie_title_id").join(seen, "movie_title_id")
                        .select("movie_id", "movie_title_id"), "batch-found")
    missing = seen.join(found.select("movie_title_id"), "movie_title_id", "left_anti")
    new = materialize(numbered_titles(missing, _max_id(movies, "movie_id")), "batch-new")
    return found.unionByName(new), new


def resolve_movie_ids(facts: DataFrame, movies: DataFrame, title_col: str = "movie_title_id"):
    """J-05: title id → surrogate id, creating missing movies.

    Returns ``(resolved facts, new movie rows)``; facts keep all columns except
    the title, which is replaced by ``movie_id``.
    """
    new = new_movie_keys(facts, movies, title_col)
    keys = movies.select("movie_id", "movie_title_id").unionByName(new)
    resolved = (facts.join(keys.withColumnRenamed("movie_title_id", title_col), title_col, "inner")
                .drop(title_col))
    return resolved, new


def upsert_users(facts: DataFrame, users: DataFrame) -> DataFrame:
    """J-06: user ids in facts that are missing from the users dimension."""
    return (facts.select("user_id").where("user_id is not null").distinct()
            .join(users.select("user_id"), "user_id", "left_anti"))


def upsert_movies(facts: DataFrame, movies: DataFrame) -> DataFrame:
    """J-07: movie ids in facts missing from the dimension, with a unique
    placeholder title id (the reference's constant collided, D-08)."""
    return (facts.select("movie_id").where("movie_id is not null").distinct()
            .join(movies.select("movie_id"), "movie_id", "left_anti")
            .withColumn("movie_title_id", F.concat(F.lit(PLACEHOLDER_PREFIX), F.col("movie_id").cast("string"))))


def insert_if_absent(batch: DataFrame, dim: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """J-12: ``INSERT … ON CONFLICT DO NOTHING``: first row per key wins inside
    the batch (by ``order_col``, else by all columns, so that the
    choice does not depend on file splits), keys already in ``dim`` are skipped.

    The per-key dedupe is a window with group limit 1, which Spark evaluates
    partially before the shuffle, so a hot key does not pile up in one task.
    """
    order = [order_col] if order_col else [c for c in batch.columns if c != key]
    w = Window.partitionBy(key).orderBy(*order)
    first = (batch.where(F.col(key).isNotNull())
             .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))
    return first.join(dim.select(key), key, "left_anti")


def load_outcome(batch: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """A-24 / D-13: numbers of inserted, in-batch duplicate, already-present and
    rejected (NULL key) rows.  Counts per key are a partial aggregate, so a hot
    key costs one row after the map side."""
    per_key = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    present = per_key.join(dim.select(key).distinct().withColumn("_present", F.lit(True)), key, "left")
    k = F.col(key)
    return present.select(
        F.sum(F.when(k.isNotNull() & F.col("_present").isNull(), 1).otherwise(0)).cast("bigint").alias("inserted"),
        F.sum(F.when(k.isNotNull() & F.col("_present").isNull(), F.col("_n") - 1).otherwise(0)).cast("bigint").alias("duplicate"),
        F.sum(F.when(k.isNotNull() & F.col("_present"), F.col("_n")).otherwise(0)).cast("bigint").alias("already_present"),
        F.sum(F.when(k.isNull(), F.col("_n")).otherwise(0)).cast("bigint").alias("rejected"),
    )
