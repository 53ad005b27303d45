"""Offline evaluation (W-04, A-11 … A-17, A-26, J-16 … J-18, T-07, T-08, U-03, U-04).

All metrics are aggregates over joins of (user, movie) pairs; nothing is
gathered per user on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_prediction
from ..functions.seeded import seeded_int
from .ordering import ordered_index

# Fixed values of the offline evaluation.
HIT_RATE_K = 30
TEST_FRACTION = 0.2
EVAL_K = 10
WATCH_HIT_MIN_MINUTES = 1
WATCH_TRUTH_MIN_MINUTES = 5


def temporal_holdout(ratings: DataFrame, order: list[str], fraction: float = TEST_FRACTION) -> DataFrame:
    """W-04: the last ``int(fraction · n_total)`` rows by time.

    As in the reference (D-12) ``n_total`` counts every row, NULL ratings
    included, while the page runs over the non-NULL rows; the page start is
    found with a distributed global index, not by funnelling through one task.
    """
    n_total = ratings.count()
    n_test = int(n_total * fraction)
    start = n_total - n_test
    rated = ratings.where(F.col("rating").isNotNull())
    indexed = ordered_index(rated, order, "_pos")
    return indexed.where((F.col("_pos") >= start) & (F.col("_pos") < start + n_test)).drop("_pos")


def eval_users(test: DataFrame, min_rows: int = 2) -> DataFrame:
    """Users with at least ``min_rows`` test rows (A-12/A-13 population)."""
    return test.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_test")).where(F.col("n_test") >= min_rows)


def rec_hits(recs: DataFrame, actual: DataFrame) -> DataFrame:
    """J-18: recommended (user, movie) pairs flagged when the user acted on the movie."""
    seen = actual.select("user_id", "movie_id").distinct().withColumn("hit", F.lit(True))
    return recs.join(seen, ["user_id", "movie_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def offline_hit_rate(recs: DataFrame, test: DataFrame, min_rows: int = 2) -> DataFrame:
    """A-12: share of eligible users with any test movie among their top-K; 0 when none."""
    users = eval_users(test, min_rows).select("user_id")
    hit_users = (rec_hits(recs.join(users, "user_id", "left_semi"), test).where("hit")
                 .select("user_id").distinct().withColumn("_h", F.lit(1)))
    agg = (users.join(hit_users, "user_id", "left")
           .agg(F.count(F.lit(1)).alias("n_users"), F.count("_h").alias("n_hits")))
    return agg.select("n_users", "n_hits",
                      F.when(F.col("n_users") > 0, F.col("n_hits") / F.col("n_users"))
                      .otherwise(F.lit(0.0)).alias("hit_rate"))


def offline_rmse(test: DataFrame, predictions: DataFrame | None = None, min_rows: int = 2) -> DataFrame:
    """A-13: RMSE of eligible users' test ratings against clipped predictions
    (default 3.0 where the model gives none, D-01)."""
    t = test.join(eval_users(test, min_rows).select("user_id"), "user_id", "left_semi")
    if predictions is not None:
        t = t.join(predictions.select("user_id", "movie_id", "prediction"), ["user_id", "movie_id"], "left")
    else:
        t = t.withColumn("prediction", F.lit(None).cast("double"))
    err = F.col("rating").cast("double") - clip_prediction("prediction")
    return t.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("n_ratings"))


def user_movie_sets(interactions: DataFrame) -> DataFrame:
    """A-11: the set of movies per user, kept as distinct (user, movie) rows
    with the set size: a heavy user's set is never gathered into one array."""
    pairs = interactions.select("user_id", "movie_id").distinct()
    sizes = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_movies"))
    return pairs.join(sizes, "user_id")


def popularity_accuracy(top: DataFrame, interactions: DataFrame, k: int = EVAL_K) -> DataFrame:
    """A-14: one top-K list for everybody: hit rate and mean precision over the
    users with interactions.  The list (≤ K rows) is broadcast."""
    top_k = top.where(F.col("rank") <= k).select("movie_id")
    per_user = interactions.select("user_id", "movie_id").distinct()
    hits = (per_user.join(F.broadcast(top_k), "movie_id")
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("hits")))
    users = per_user.select("user_id").distinct()
    j = users.join(hits, "user_id", "left").fillna(0, ["hits"])
    return j.agg(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
                 F.avg(F.col("hits") / F.lit(float(k))).alias("precision_at_k"),
                 F.count(F.lit(1)).alias("n_users"))


def cf_accuracy(recs: DataFrame, watch: DataFrame, k: int = EVAL_K,
                min_minutes: int = WATCH_HIT_MIN_MINUTES) -> DataFrame:
    """A-15: stored lists against watch rows: every qualifying watch row of a
    recommended movie is a hit (repeat views count again); denominators are
    the users with lists.  Views are counted per (user, movie) before the join, so a pair
    seen very often is one row of it, and a user has at most K."""
    rec_pairs = recs.select("user_id", "movie_id").distinct()
    rec_users = rec_pairs.select("user_id").distinct()
    w = watch.where(F.col("watched_minutes") >= min_minutes).groupBy("user_id", "movie_id").agg(F.count(F.lit(1)).alias("views"))
    hits = w.join(rec_pairs, ["user_id", "movie_id"]).groupBy("user_id").agg(F.sum("views").alias("hits"))
    j = rec_users.join(hits, "user_id", "left").fillna(0, ["hits"])
    return j.agg(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
                 (F.sum("hits") / (F.lit(float(k)) * F.count(F.lit(1)))).alias("precision_at_k"),
                 F.count(F.lit(1)).alias("n_users"))


def hr_at_k(recs: DataFrame, test: DataFrame) -> DataFrame:
    """A-16: users with ≥1 recommended movie in their test set / users with recs."""
    users = recs.select("user_id").distinct()
    hit = rec_hits(recs, test).where("hit").select("user_id").distinct().withColumn("h", F.lit(1.0))
    return (users.join(hit, "user_id", "left").fillna(0.0, ["h"])
            .agg(F.avg("h").alias("hr_at_k"), F.count(F.lit(1)).alias("n_users")))


def precision_at_k(recs: DataFrame, test: DataFrame, k: int = EVAL_K) -> DataFrame:
    """A-17: mean hits/K over users with recs *and* test rows; 0 when none."""
    test_users = test.select("user_id").distinct()
    r = recs.join(test_users, "user_id", "left_semi")
    per_user = (rec_hits(r, test).groupBy("user_id")
                .agg(F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("hits")))
    return per_user.agg(F.coalesce(F.avg(F.col("hits") / F.lit(float(k))), F.lit(0.0)).alias("precision_at_k"),
                        F.count(F.lit(1)).alias("n_users"))


def rec_coverage(test_users: DataFrame, model_users: DataFrame, recs: DataFrame) -> DataFrame:
    """A-26: test users, model users, test users missing from the model, and
    test users whose list is empty."""
    t = test_users.select("user_id").distinct().withColumn("_t", F.lit(1))
    m = model_users.select("user_id").distinct().withColumn("_m", F.lit(1))
    r = recs.select("user_id").distinct().withColumn("_r", F.lit(1))
    j = t.join(m, "user_id", "full").join(r, "user_id", "left")
    t_, m_, r_ = F.col("_t").isNotNull(), F.col("_m").isNotNull(), F.col("_r").isNotNull()
    return j.agg(F.count("_t").alias("n_test_users"), F.count("_m").alias("n_model_users"),
                 F.count(F.when(t_ & ~m_, 1)).alias("n_missing_users"),
                 F.count(F.when(t_ & ~r_, 1)).alias("n_empty_lists"))


def first_n_users(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """T-07: the first ``n`` distinct users in input order (by first row position),
    and J-16: all their rows (not only those read before the sample filled, D-14)."""
    key = F.struct(*[F.col(c) for c in order])
    first = rows.groupBy("user_id").agg(F.min(key).alias("_first"))
    chosen = first.orderBy("_first").limit(n).select("user_id")   # TakeOrderedAndProject: n rows per task
    return rows.join(chosen, "user_id", "left_semi")


def sample_users(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """T-08: seeded pseudo-random sample of ``n`` distinct users without
    replacement: users ordered by a seeded draw (ties by id), first n kept —
    ``TakeOrderedAndProject`` keeps n rows per task, independent of
    partitioning."""
    users = rows.select("user_id").distinct()
    key = seeded_int(F.col("user_id"), F.lit(0), seed)
    return users.orderBy(key, "user_id").limit(n)


def watch_truth(ratings: DataFrame, watch: DataFrame, min_minutes: int = WATCH_TRUTH_MIN_MINUTES) -> DataFrame:
    """J-17: every rating with the user's watch rows of that movie; truth =
    watched at least ``min_minutes``."""
    w = watch.select("user_id", "movie_id", "watched_minutes")
    return (ratings.join(w, ["user_id", "movie_id"], "left")
            .withColumn("truth", F.coalesce(F.col("watched_minutes") >= min_minutes, F.lit(False))))
