"""Table access: filtered reads, joins with the movie dimension, paging, time
splits, parameterised SQL (S-08 … S-10, J-01 … J-04, A-01, T-03).

Filters are plain predicates so Catalyst pushes them into the Parquet scan;
joins are equi-joins whose strategy AQE picks from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CUTOFF = "2025-03-01 00:00:00"


def _unique(*cols: str) -> list[str]:
    """Column list without repeats (a tie-break may already be an output column)."""
    return list(dict.fromkeys(cols))


def page(df: DataFrame, order: list[Column | str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """T-03: total-order page (``None`` limit = to the end, D-10).

    ``orderBy().offset().limit()`` plans as TakeOrderedAndProject(limit+offset),
    which is cheap for front pages; for deep, data-sized offsets use
    :func:`marquee.operators.ordering.ordered_index` instead.
    """
    if limit is None and not offset:
        return df  # the whole table: no page, no sort
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def movies_page(movies: DataFrame, limit: int | None = 1000, offset: int = 0) -> DataFrame:
    """S-09: rated movies, paged by id (order added, D-11)."""
    rated = (movies.where(F.col("rating").isNotNull() & F.col("votes").isNotNull())
             .select("movie_id", "title", "rating", "votes", "genres"))
    return page(rated, ["movie_id"], limit, offset)


def sql_params(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """S-10: parameterised SQL over registered views (reads only)."""
    return spark.sql(text, args=args or {})


def watch_chunk(watch: DataFrame, movies: DataFrame, limit=None, offset=0,
                tie: tuple[str, ...] = ("watch_id",)) -> DataFrame:
    """J-01: watch ⋈ movies (genres present), time order, paged."""
    m = movies.where(F.col("genres").isNotNull()).select("movie_id", "title", "genres")
    j = watch.join(m, "movie_id")
    return page(j, ["updated_at", *tie], limit, offset).select(
        "user_id", "movie_id", "watched_minutes", "title", "genres", *tie)


def ratings_chunk(ratings: DataFrame, movies: DataFrame, limit=None, offset=0,
                  tie: tuple[str, ...] = ("rating_id",)) -> DataFrame:
    """J-02: ratings ⋈ movies (rating present), time order, paged."""
    j = ratings.where(F.col("rating").isNotNull()).join(movies.select("movie_id", "title", "genres"), "movie_id")
    return page(j, ["updated_at", *tie], limit, offset).select(
        *_unique("user_id", "movie_id", "rating", "title", "genres", "updated_at", *tie))


def _split(col: str, cutoff: str, mode: str) -> Column:
    ts = F.lit(cutoff).cast("timestamp_ntz")
    if mode == "train":
        return F.col(col) <= ts
    if mode == "test":
        return F.col(col) > ts
    raise ValueError("mode must be 'train' or 'test'")


def eval_ratings(ratings: DataFrame, movies: DataFrame, cutoff: str = DEFAULT_CUTOFF, mode: str = "train",
                 limit=None, offset=0, tie: tuple[str, ...] = ("rating_id",)) -> DataFrame:
    """J-03: ratings ⋈ movies split at ``cutoff`` (train ≤, test >)."""
    r = ratings.where(F.col("rating").isNotNull() & _split("updated_at", cutoff, mode))
    j = r.join(movies.select("movie_id", F.col("title").alias("movie_title")), "movie_id")
    return page(j, ["updated_at", *tie], limit, offset).select(
        *_unique("user_id", "movie_id", "movie_title", "rating", "updated_at", *tie))


def eval_watch(watch: DataFrame, movies: DataFrame, cutoff: str = DEFAULT_CUTOFF, mode: str = "train",
               limit=None, offset=0, tie: tuple[str, ...] = ("watch_id",)) -> DataFrame:
    """J-04: watch ⋈ movies split at ``cutoff``, minutes present, with plot when
    the dimension carries one."""
    w = watch.where(F.col("watched_minutes").isNotNull() & _split("updated_at", cutoff, mode))
    cols = ["movie_id", "title", "genres"] + (["plot"] if "plot" in movies.columns else [])
    j = w.join(movies.select(*cols), "movie_id")
    return page(j, ["updated_at", *tie], limit, offset).select(
        "user_id", "movie_id", "watched_minutes", *cols[1:], *tie)


def count_ratings(ratings: DataFrame) -> DataFrame:
    """A-01: all rating rows, NULL ratings included."""
    return ratings.agg(F.count(F.lit(1)).alias("n_ratings"))
