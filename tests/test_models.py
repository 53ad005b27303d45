"""Model operators on hand-made frames (FIXTURES §3) and invariants."""
import datetime as dt

from pyspark.sql import functions as F

from marquee.functions.scalar import clip_prediction, hybrid_alpha_beta, title_or_unknown
from marquee.operators import content, evaluation, hybrid, metrics, popularity, scoring

T0 = dt.datetime(2025, 1, 1)


def test_hybrid_weight_tiers(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 9, 10, 19, 20)] + [(None,)], "n int")
    a, b = hybrid_alpha_beta(F.col("n"))
    got = [(r[0], r[1]) for r in df.select(a, b).collect()]
    assert got == [(0.0, 1.0), (0.4, 0.6), (0.4, 0.6), (0.6, 0.4), (0.6, 0.4), (0.8, 0.2), (0.0, 1.0)]


def test_unknown_user_gets_content_only(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    profiles = spark.createDataFrame([(1, "drama", 1.0)], "user_id long, genre string, weight double")
    counts = spark.createDataFrame([(2, 25)], "user_id long, n_rated long")
    got = {r.user_id: (r.alpha, r.beta) for r in hybrid.hybrid_weights(users, profiles, counts).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.8, 0.2), 3: (0.0, 1.0)}


def test_title_and_clip(spark):
    df = spark.createDataFrame([(999, None, None), (1, "a+1", 0.2), (2, "b", 7.0)], "id long, t string, p double")
    got = df.select(title_or_unknown("t", "id"), clip_prediction("p")).collect()
    assert [tuple(r) for r in got] == [("Unknown Title (999)", 3.0), ("a+1", 1.0), ("b", 5.0)]


def test_bayesian_score_at_prior_weight(spark):
    movies = spark.createDataFrame([(1, 4.0, 10), (2, 2.0, 10)], "movie_id long, rating double, votes int")
    scored = {r.movie_id: r.popularity_score for r in popularity.bayesian_score(movies).collect()}
    # v = m → score is the mean of R and C (C = 3.0)
    assert scored == {1: 3.5, 2: 2.5}


def test_profile_frequency_squared_and_normalised(spark):
    watch = spark.createDataFrame([(1, 10, 40, T0)] * 3 + [(1, 11, 40, T0)],
                                  "user_id long, movie_id long, watched_minutes int, updated_at timestamp_ntz")
    movies = spark.createDataFrame([(10, ["Drama"]), (11, ["Comedy"])], "movie_id long, genres array<string>")
    raw = {r.genre: r.raw_weight for r in content.user_profiles_raw(watch, movies).collect()}
    assert abs(raw["drama"] - 3 * 3 * 0.5) < 1e-12 and abs(raw["comedy"] - 0.5) < 1e-12
    prof = content.user_profiles(watch, movies)
    assert abs(prof.agg(F.sum("weight")).first()[0] - 1.0) < 1e-12


def test_similar_movies_twin_first_and_self_excluded(spark):
    movies = spark.createDataFrame(
        [(1, "m1", ["a", "b"], 4.0, 3), (2, "m2", ["a", "b"], 4.0, 3), (3, "m3", ["a"], 4.0, 3),
         (4, "m4", ["c"], 4.0, 3)],
        "movie_id long, title string, genres array<string>, rating double, votes int")
    vocab = spark.createDataFrame([("a",), ("b",), ("c",)], "genre string")
    vectors = content.movie_vectors(movies, vocab)
    sim = hybrid.similar_movies(vectors, movies, n=3)
    got = [(r.movie_id, r.score) for r in sim.where("query_movie_id = 1").orderBy("rank").collect()]
    assert got[0] == (2, 0.5)            # twin first
    assert (3, 0.5) != got[0] and got[1] == (3, 0.5)   # subset ties on score, later id
    assert all(m != 1 for m, _ in got)
    assert got[2] == (4, 0.0)            # zero scorer fills the list


def test_popularity_fallback_in_order(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    scored = spark.createDataFrame([(1,)], "user_id long")
    popular = spark.createDataFrame([(1, 50, 3.1), (2, 40, 3.0), (3, 30, 2.9)],
                                    "rank int, movie_id long, popularity_score double")
    fb = hybrid.popularity_fallback(users, scored, popular, n=2).orderBy("rank").collect()
    assert [(r.user_id, r.rank, r.movie_id) for r in fb] == [(2, 1, 50), (2, 2, 40)]


def test_precision_excludes_users_without_test_rows(spark):
    recs = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "user_id long, movie_id long")
    test = spark.createDataFrame([(1, 10)], "user_id long, movie_id long")
    p = evaluation.precision_at_k(recs, test, k=2).first()
    h = evaluation.hr_at_k(recs, test).first()
    assert p.n_users == 1 and abs(p.precision_at_k - 0.5) < 1e-12
    assert h.n_users == 2 and abs(h.hr_at_k - 0.5) < 1e-12


def test_items_histogram(spark):
    req = spark.createDataFrame([(0,), (1,), (6,), (51,)], "n_items int")
    got = {r.le: r["count"] for r in metrics.items_histogram(req).collect()}
    assert got["1"] == 2 and got["5"] == 2 and got["10"] == 3 and got["50"] == 3 and got["+Inf"] == 4


def test_top_n_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 4, 2.0), (2, 9, 0.5)],
                               "user_id long, movie_id long, s double")
    got = [(r.user_id, r.movie_id) for r in scoring.top_n_per_key(df, "user_id", "s", "movie_id", 2)
           .orderBy("user_id", "rank").collect()]
    assert got == [(1, 4), (1, 3), (2, 9)]
