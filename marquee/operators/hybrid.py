"""Blending and per-user lists (P-25, P-26, J-11, J-15, M-03, M-04, M-08, M-09, M-10).

Recommendations are produced for all requested users in one plan rather than
one request at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hybrid_alpha_beta, title_or_unknown
from ..session import materialize
from . import collaborative, content, scoring

RECS_TOP_N = 20
SIMILAR_TOP_N = 5


def attach_list(df: DataFrame, small: DataFrame, limit: int) -> DataFrame:
    """Give every row of ``df`` all rows of ``small`` (≤ ``limit`` rows, checked).

    The bounded list is read once on the driver and attached as a literal
    array that each task explodes locally: no join, no shuffle.
    """
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"list larger than its bound {limit}")
    if not rows:
        return df.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in small.dtypes])
    lit = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in small.dtypes]) for r in rows])
    return df.select("*", F.explode(lit).alias("_e")).select(*df.columns, *[F.col(f"_e.{c}").alias(c)
                                                                           for c in small.columns])


# ----------------------------------------------------------------- inputs
def rating_counts(ratings: DataFrame) -> DataFrame:
    """A-02: non-null ratings per user (partial + final aggregate)."""
    return ratings.groupBy("user_id").agg(F.count("rating").alias("n_rated"))


def known_users(profiles: DataFrame, counts: DataFrame) -> DataFrame:
    """P-26: users with a profile or a rating count."""
    return profiles.select("user_id").union(counts.select("user_id")).distinct()


def hybrid_weights(users: DataFrame, profiles: DataFrame, counts: DataFrame) -> DataFrame:
    """P-25 for every requested user: unknown → (0, 1); else tiers on n_rated."""
    known = known_users(profiles, counts).withColumn("_known", F.lit(True))
    j = (users.select("user_id").distinct().join(known, "user_id", "left")
         .join(counts, "user_id", "left"))
    n = F.when(F.col("_known"), F.coalesce(F.col("n_rated"), F.lit(0))).otherwise(F.lit(0))
    alpha, beta = hybrid_alpha_beta(n)
    return j.select("user_id", n.cast("bigint").alias("n_rated"), alpha.alias("alpha"), beta.alias("beta"))


def title_map(movies: DataFrame) -> DataFrame:
    """J-11: movie id → title id (the reference's map holds ``movie_title_id``)."""
    return movies.select("movie_id", F.col("movie_title_id").alias("title"))


def name_movies(recs: DataFrame, movies: DataFrame) -> DataFrame:
    """J-11 + P-28: attach titles, ``Unknown Title (<id>)`` when missing."""
    return (recs.join(title_map(movies), "movie_id", "left")
            .withColumn("title", title_or_unknown(F.col("title"), F.col("movie_id"))))


# ----------------------------------------------------------------- content lists
def content_top_n(profiles: DataFrame, vectors: DataFrame, universe: DataFrame, n: int = RECS_TOP_N,
                  positive_only: bool = False) -> DataFrame:
    """M-04 core: per profiled user, the ``n`` best movies of ``universe`` by
    ``profile · vector`` (ties by id).  Movies sharing a genre set share a
    vector, so users are scored against signatures; a signature that places
    a movie in the top n is among the user's n best signatures ordered by
    (score desc, lowest member id), and only its n lowest ids can be used.
    Without ``positive_only`` the list is completed with the lowest-id zero
    scorers, as the reference's full sort does.
    """
    sig_vec, members = content.signatures(vectors)
    # n lowest ids per signature (group-limited window: a huge signature keeps n rows per task)
    low = members.withColumn("_r", F.row_number().over(Window.partitionBy("sig").orderBy("movie_id"))) \
        .where(F.col("_r") <= n).drop("_r")
    # each signature carries its <= n lowest member ids, so the scorer
    # expands signatures to movies inside the task (no expansion join)
    member_lists = low.groupBy("sig").agg(F.sort_array(F.collect_list("movie_id")).alias("members"))
    q = scoring.to_sparse(profiles, "user_id", "genre", "weight")
    items = (scoring.to_sparse(sig_vec.withColumnRenamed("min_movie_id", "sig_id"), "sig_id", "genre", "weight")
             .join(sig_vec.select("sig", F.col("min_movie_id").alias("sig_id")).distinct(), "sig_id")
             .join(member_lists, "sig")
             .select("sig_id", F.col("sig_id").alias("tie"), "keys", "weights", "members"))
    top = scoring.topk_dot(q, "user_id", items, "sig_id", "tie", n, positive_only=True, members="members")
    positive = top.select("user_id", F.col("item_id").alias("movie_id"), "score")
    if not positive_only:
        positive = materialize(positive, "content-positive")      # read twice below
        positive = _fill_with_zeros(positive, profiles.select("user_id").distinct(), universe, n)
    return scoring.top_n_per_key(positive, "user_id", "score", "movie_id", n)


def _fill_with_zeros(positive: DataFrame, users: DataFrame, universe: DataFrame, n: int) -> DataFrame:
    """Complete lists shorter than n with zero-score movies, lowest ids first.

    Only the 2n lowest ids of the universe can be needed (at most n-1 of them
    are positive for a user whose list is short); that set is bounded by n.
    """
    lowest = universe.select("movie_id").distinct().orderBy("movie_id").limit(2 * n)
    counts = positive.groupBy("user_id").agg(F.count(F.lit(1)).alias("_np"))
    short = users.join(counts, "user_id", "left").where(F.coalesce(F.col("_np"), F.lit(0)) < n).select("user_id")
    zeros = (attach_list(short, lowest, 2 * n)
             .join(positive.select("user_id", "movie_id"), ["user_id", "movie_id"], "left_anti")
             .withColumn("score", F.lit(0.0)))
    return positive.unionByName(zeros)


def content_recs(profiles: DataFrame, vectors: DataFrame, universe: DataFrame, movies: DataFrame,
                 n: int = RECS_TOP_N) -> DataFrame:
    """M-04: content-only top-n per profiled user with titles."""
    top = content_top_n(profiles, vectors, universe, n)
    return name_movies(top, movies).select("user_id", "rank", "movie_id", "title",
                                           F.round("score", scoring.SCORE_DP).alias("score"))


# ----------------------------------------------------------------- similar movies
def similar_movies(vectors: DataFrame, universe: DataFrame, n: int = SIMILAR_TOP_N) -> DataFrame:
    """M-03: for every movie of the universe, the n most similar others by
    vector dot product (self excluded by id, ties by id, zero scorers fill)."""
    sig_vec, members = content.signatures(vectors)
    k = n + 1          # one more signature / member than needed: the query movie itself drops out
    sig_key = sig_vec.select("sig", F.col("min_movie_id").alias("sig_id")).distinct()
    sig_sparse = scoring.to_sparse(sig_vec, "min_movie_id", "genre", "weight") \
        .withColumnRenamed("min_movie_id", "sig_id")
    low = members.withColumn("_r", F.row_number().over(Window.partitionBy("sig").orderBy("movie_id"))) \
        .where(F.col("_r") <= k).drop("_r")
    member_lists = low.groupBy("sig").agg(F.sort_array(F.collect_list("movie_id")).alias("members"))
    items = (sig_sparse.join(sig_key, "sig_id").join(member_lists, "sig")
             .select("sig_id", F.col("sig_id").alias("tie"), "keys", "weights", "members"))
    # every movie with a vector asks with its signature's vector
    queries = (members.join(sig_key, "sig").join(sig_sparse, "sig_id")
               .select(F.col("movie_id").alias("query_movie_id"), "keys", "weights"))
    top = scoring.topk_dot(queries, "query_movie_id", items, "sig_id", "tie", k, positive_only=True,
                           exclude_self=True, members="members", keep=n)
    cand = top.select("query_movie_id", F.col("item_id").alias("movie_id"), "score")
    cand = materialize(cand, "similar-candidates")                # read three times below
    all_movies = universe.select(F.col("movie_id").alias("query_movie_id")).distinct()
    lowest = universe.select("movie_id").distinct().orderBy("movie_id").limit(2 * n + 1)
    counts = cand.groupBy("query_movie_id").agg(F.count(F.lit(1)).alias("_np"))
    short = (all_movies.join(counts, "query_movie_id", "left")
             .where(F.coalesce(F.col("_np"), F.lit(0)) < n).select("query_movie_id"))
    zeros = (attach_list(short, lowest, 2 * n + 1)
             .where(F.col("movie_id") != F.col("query_movie_id"))
             .join(cand.select("query_movie_id", "movie_id"), ["query_movie_id", "movie_id"], "left_anti")
             .withColumn("score", F.lit(0.0)))
    ranked = scoring.top_n_per_key(cand.unionByName(zeros), "query_movie_id", "score", "movie_id", n)
    return ranked.select("query_movie_id", "rank", "movie_id", F.round("score", scoring.SCORE_DP).alias("score"))


# ----------------------------------------------------------------- hybrid
def hybrid_scores(cf: DataFrame, cb: DataFrame, weights: DataFrame) -> DataFrame:
    """J-15: align CF ``(user, movie, cf_score)`` and CB ``(user, movie, score)``
    by a full outer join on the pair, missing side 0, ``α·cf + β·cb``, keep > 0."""
    both = (cf.select("user_id", "movie_id", F.col("cf_score").alias("cf"))
            .join(cb.select("user_id", "movie_id", F.col("score").alias("cb")), ["user_id", "movie_id"], "full")
            .fillna(0.0, ["cf", "cb"]))
    s = F.col("alpha") * F.col("cf") + F.col("beta") * F.col("cb")
    return both.join(weights.select("user_id", "alpha", "beta"), "user_id").select(
        "user_id", "movie_id", s.alias("score")).where(F.col("score") > 0)


def popularity_fallback(users: DataFrame, scored_users: DataFrame, popular: DataFrame,
                        n: int = RECS_TOP_N, extra: tuple[str, ...] = ()) -> DataFrame:
    """M-09: requested users without any positive score get the popular top-n,
    in order.  The popular list is bounded by n and attached as a literal."""
    missing = users.select("user_id").distinct().join(scored_users.select("user_id").distinct(), "user_id",
                                                      "left_anti")
    top = popular.where(F.col("rank") <= n).select("rank", "movie_id", F.col("popularity_score").alias("score"),
                                                   *extra)
    return attach_list(missing, top, n)


def hybrid_recommend(users: DataFrame, profiles: DataFrame, vectors: DataFrame, counts: DataFrame,
                     popular: DataFrame, movies: DataFrame, universe: DataFrame,
                     user_factors: DataFrame | None = None, item_factors: DataFrame | None = None,
                     n: int = RECS_TOP_N) -> DataFrame:
    """M-08 for every requested user: ``α·cf + β·cb`` over the universe, keep
    score > 0, top-n by (score desc, id), titles; empty → popular list.

    Without factors the CF side is empty (the reference's effective
    behaviour, D-01) and the order is the content order scaled by β.
    With factors (long form ``(id, dim, value)``) both sides are folded into
    one dot product: ``[α·U_u, β·p_u] · [V_m, v_m]``.
    """
    w = hybrid_weights(users, profiles, counts)
    if user_factors is None or item_factors is None:
        # score = β·cb: scale each profile by the user's β so ranking is on the blended score
        scaled = (profiles.join(w.where(F.col("beta") > 0), "user_id")
                  .select("user_id", "genre", (F.col("weight") * F.col("beta")).alias("weight")))
        top = content_top_n(scaled, vectors, universe, n, positive_only=True).select(
            "user_id", "rank", "movie_id", "score")
    else:
        top = _hybrid_with_factors(w, profiles, vectors, user_factors, item_factors, universe, n)
    # The lists (≤ n rows per user) feed both the output and the fallback's
    # anti-join: write them once instead of scoring twice.
    top = materialize(top, "hybrid-top")
    # The fallback list is the same N movies for every user: name them before
    # the list is attached, so no join is keyed on those N hot movie ids.
    named_popular = name_movies(popular.where(F.col("rank") <= n), movies)
    fallback = popularity_fallback(w, top, named_popular, n, extra=("title",))
    hyb = name_movies(top, movies).select("user_id", "rank", "movie_id", "title", "score",
                                          F.lit("hybrid").alias("source"))
    fb = fallback.select("user_id", "rank", "movie_id", "title", "score", F.lit("popular").alias("source"))
    return hyb.unionByName(fb).select("user_id", "rank", "movie_id", "title",
                                      F.round("score", scoring.SCORE_DP).alias("score"), "source")


def _hybrid_with_factors(w, profiles, vectors, user_factors, item_factors, universe, n):
    """Both models in one score: dense ``α·U · V`` plus sparse ``β·profile · vector``."""
    dims = item_factors.agg(F.max("dim")).first()[0]
    k = 0 if dims is None else dims + 1
    # user side: α·U and β·profile
    uf = collaborative.to_vectors(user_factors, "user_id", k).join(w, "user_id") \
        .select("user_id", F.transform("vec", lambda x: F.coalesce(x * F.col("alpha"), F.lit(0.0))).alias("vec"))
    up = scoring.to_sparse(profiles.join(w, "user_id").select("user_id", "genre", (F.col("weight") * F.col("beta")).alias("w")),
                           "user_id", "genre", "w")
    # item side over the universe
    uni = universe.select("movie_id").distinct()
    itf = collaborative.to_vectors(item_factors, "movie_id", k).join(uni, "movie_id", "left_semi") \
        .select("movie_id", F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0))).alias("vec"))
    itv = scoring.to_sparse(vectors.join(uni, "movie_id", "left_semi"), "movie_id", "genre", "weight")
    items = itf.join(itv, "movie_id", "full").withColumn("tie", F.col("movie_id"))
    top = scoring.topk_dot(uf.join(up, "user_id", "full"), "user_id", items, "movie_id", "tie", n, positive_only=True)
    return top.select("user_id", "rank", F.col("item_id").alias("movie_id"), "score")


def get_recs(users: DataFrame, source: DataFrame, k: int, shape: str) -> DataFrame:
    """M-10: lookup over three shapes.

    ``global``: one ranked list for everybody (bounded by k, attached as a literal);
    ``per_user``: a (user, rank, movie) table, users without rows get none;
    ``model``: output of :func:`hybrid_recommend` (already per user).
    """
    if shape == "global":
        top = source.where(F.col("rank") <= k).select("rank", "movie_id")
        return attach_list(users.select("user_id").distinct(), top, k)
    return (users.select("user_id").distinct().join(source.where(F.col("rank") <= k), "user_id")
            .select("user_id", "rank", "movie_id"))
