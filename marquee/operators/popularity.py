"""Bayesian popularity model (M-01: P-16 → A-03 → A-04 → T-01, J-08, T-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import exact_percentiles

# List length and the vote-count quantile used as prior weight.
POPULAR_TOP_N = 50
VOTES_QUANTILE = 0.90
SCORE_DP = 6


def movies_rated(movies: DataFrame) -> DataFrame:
    """S-08: movies with rating and votes present (pushed to the scan)."""
    return (movies.where(F.col("rating").isNotNull() & F.col("votes").isNotNull())
            .select("movie_id", "title", "rating", "votes", "genres"))


def _params(movies: DataFrame) -> tuple[float, float]:
    """C = mean rating (one partial aggregate) and m = exact 90th percentile of
    votes with linear interpolation (distributed global index, no value
    gathering)."""
    rated = movies.dropna(subset=["rating", "votes"])
    mean = rated.agg(F.avg("rating")).first()[0]
    (m,) = exact_percentiles(rated, "votes", [VOTES_QUANTILE])
    return mean, m


def popularity_params(movies: DataFrame) -> DataFrame:
    """A-03: one row (mean_rating, min_votes)."""
    mean, m = _params(movies)
    return movies.sparkSession.createDataFrame([(mean, m)], "mean_rating double, min_votes double")


def bayesian_score(movies: DataFrame, mean_rating=None, min_votes=None) -> DataFrame:
    """A-04: ``v/(v+m)·R + m/(v+m)·C`` for every rated movie.

    The two global parameters come from a one-row aggregate and are bound as
    literals, so scoring is a narrow projection (no join, no shuffle).
    """
    rated = movies.dropna(subset=["rating", "votes"])
    if mean_rating is None or min_votes is None:
        mean_rating, min_votes = _params(movies)
    if mean_rating is None:          # no rated movie at all
        return rated.select("movie_id", F.lit(None).cast("double").alias("popularity_score")).limit(0)
    v = F.col("votes").cast("double")
    m = F.lit(float(min_votes))
    score = v / (v + m) * F.col("rating") + m / (v + m) * F.lit(float(mean_rating))
    return rated.select("movie_id", F.round(score, SCORE_DP).alias("popularity_score"))


def popular_movies(movies: DataFrame, top_n: int = POPULAR_TOP_N) -> DataFrame:
    """T-01: top-N by score (ties by id) → ``(rank, movie_id, popularity_score)``.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps N rows.
    """
    top = bayesian_score(movies).orderBy(F.desc("popularity_score"), "movie_id").limit(top_n)
    w = Window.orderBy(F.desc("popularity_score"), "movie_id")  # ≤ top_n rows
    return top.select(F.row_number().over(w).alias("rank"), "movie_id", "popularity_score")


def popular_prefix(popular: DataFrame, n: int) -> DataFrame:
    """T-02: the first ``n`` entries of a popularity list."""
    return popular.where(F.col("rank") <= n)


def popular_details(movies: DataFrame, popular: DataFrame) -> DataFrame:
    """J-08: movie rows whose id is in the (bounded, top-N) popularity list."""
    return movies.join(F.broadcast(popular.select("movie_id")), "movie_id", "left_semi")
