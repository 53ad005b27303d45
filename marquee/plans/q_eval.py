"""Registered queries: table access, paging, evaluation, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables, cte
from ..functions import parsing
from ..functions.scalar import clip_prediction, title_or_unknown
from ..functions.seeded import seeded_int_sql
from ..operators import collaborative as cf
from ..operators import dimensions
from ..operators import evaluation as ev
from ..operators import hybrid
from ..operators import popularity as pop
from ..sources import tables as tb
from . import q_ingest as qi
from . import q_models as qm
from .registry import query


def _round6(df):
    """Round every floating-point column to 6 dp (sums merge in any order)."""
    return df.select([F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


R_ORDER = ["updated_at", "l_orderkey", "l_linenumber", "movie_id", "l_suppkey", "l_extendedprice"]
R_ORDER_SQL = ", ".join(R_ORDER)
RATINGS_CUTOFF = "2000-06-01 00:00:00"
WATCH_CUTOFF = "2024-01-25 00:00:00"
R_TIE = tuple(R_ORDER[1:])


# ---------------------------------------------------------------- access
@query("movies_page", cte("fx_movies") + "select movie_id, title, rating, votes, genres from fx_movies "
       "where rating is not null and votes is not null order by movie_id limit 1000 offset 1000", text_arrays=("genres",))
def q_movies_page(spark, sf):
    return tb.movies_page(Tables(spark, sf).movies, limit=1000, offset=1000)


@query("sql_params", cte("fx_movies") + "select movie_id, title, votes from fx_movies "
       "where year >= 1990 and votes >= 30")
def q_sql_params(spark, sf):
    Tables(spark, sf)
    return tb.sql_params(spark, "select movie_id, title, votes from fx_movies "
                                "where year >= :min_year and votes >= :min_votes",
                         {"min_year": 1990, "min_votes": 30})


@query("watch_chunk", cte("fx_movies", "fx_watch") +
       "select w.user_id, w.movie_id, w.watched_minutes, m.title, m.genres, w.watch_id from fx_watch w "
       "join fx_movies m using (movie_id) where m.genres is not null order by w.updated_at, w.watch_id "
       "limit 2000 offset 1000", text_arrays=("genres",))
def q_watch_chunk(spark, sf):
    t = Tables(spark, sf)
    return tb.watch_chunk(t.watch, t.movies, limit=2000, offset=1000)


@query("ratings_chunk", cte("fx_movies", "fx_ratings") +
       "select r.user_id, r.movie_id, r.rating, m.title, m.genres, r.updated_at, "
       + ", ".join(f"r.{c}" for c in R_TIE if c != "movie_id") + " from fx_ratings r join fx_movies m using (movie_id) "
       "where r.rating is not null order by " + ", ".join(f"r.{c}" for c in R_ORDER) + " limit 5000 offset 10000", text_arrays=("genres",))
def q_ratings_chunk(spark, sf):
    t = Tables(spark, sf)
    return tb.ratings_chunk(t.ratings, t.movies, limit=5000, offset=10000, tie=R_TIE)


def _eval_ratings_sql(op):
    return (cte("fx_movies", "fx_ratings") +
            "select r.user_id, r.movie_id, m.title as movie_title, r.rating, r.updated_at, "
            + ", ".join(f"r.{c}" for c in R_TIE if c != "movie_id") + " from fx_ratings r join fx_movies m using (movie_id) "
            f"where r.rating is not null and r.updated_at {op} timestamp '{RATINGS_CUTOFF}'")


@query("eval_ratings_train", _eval_ratings_sql("<="))
def q_eval_ratings_train(spark, sf):
    t = Tables(spark, sf)
    return tb.eval_ratings(t.ratings, t.movies, RATINGS_CUTOFF, "train", tie=R_TIE)


@query("eval_ratings_test", _eval_ratings_sql(">"))
def q_eval_ratings_test(spark, sf):
    t = Tables(spark, sf)
    return tb.eval_ratings(t.ratings, t.movies, RATINGS_CUTOFF, "test", tie=R_TIE)


def _eval_watch_sql(op):
    return (cte("fx_movies", "fx_watch") +
            "select w.user_id, w.movie_id, w.watched_minutes, m.title, m.genres, w.watch_id "
            "from fx_watch w join fx_movies m using (movie_id) "
            f"where w.watched_minutes is not null and w.updated_at {op} timestamp '{WATCH_CUTOFF}'")


@query("eval_watch_train", _eval_watch_sql("<="), text_arrays=("genres",))
def q_eval_watch_train(spark, sf):
    t = Tables(spark, sf)
    return tb.eval_watch(t.watch, t.movies, WATCH_CUTOFF, "train")


@query("eval_watch_test", _eval_watch_sql(">"), text_arrays=("genres",))
def q_eval_watch_test(spark, sf):
    t = Tables(spark, sf)
    return tb.eval_watch(t.watch, t.movies, WATCH_CUTOFF, "test")


@query("count_ratings", cte("fx_ratings") + "select count(*) as n_ratings from fx_ratings")
def q_count_ratings(spark, sf):
    return tb.count_ratings(Tables(spark, sf).ratings)


# ---------------------------------------------------------------- holdout and samples
_HOLDOUT = f"""rated_ AS (select *, row_number() over (order by {R_ORDER_SQL}) - 1 as pos
           from fx_ratings where rating is not null),
holdout AS (select user_id, movie_id, rating, updated_at, l_orderkey, l_linenumber from rated_
            where pos >= (select count(*) - cast(floor(count(*) * 0.2) as bigint) from rated_))"""


def _holdout(t):
    rated = t.ratings.where(F.col("rating").isNotNull())
    return ev.temporal_holdout(rated, R_ORDER).select("user_id", "movie_id", "rating", "updated_at",
                                                      "l_orderkey", "l_linenumber")


@query("temporal_holdout", cte("fx_ratings", extra=_HOLDOUT) + "select * from holdout")
def q_temporal_holdout(spark, sf):
    """W-04 over the rated rows (the total is taken over the same rows; the
    reference's count of NULL rows, D-12, would leave an empty page here)."""
    return _holdout(Tables(spark, sf))


_FIRST = f"""firsts AS (select user_id from (select user_id, min(struct_pack({', '.join(f'{c} := {c}' for c in R_ORDER)})) as f
                                           from fx_ratings group by user_id) order by f limit {{N}})"""


@query("first_n_users", cte("fx_ratings", extra=_FIRST.replace("{N}", "500")) + "select user_id from firsts")
def q_first_n_users(spark, sf):
    r = Tables(spark, sf).ratings
    return ev.first_n_users(r, R_ORDER, 500).select("user_id").distinct()


@query("rows_of_sampled_users", cte("fx_ratings", extra=_FIRST.replace("{N}", "500")) +
       "select user_id, movie_id, rating, updated_at, l_orderkey, l_linenumber from fx_ratings "
       "where user_id in (select user_id from firsts)")
def q_rows_of_sampled_users(spark, sf):
    r = Tables(spark, sf).ratings
    return ev.first_n_users(r, R_ORDER, 500).select("user_id", "movie_id", "rating", "updated_at",
                                                    "l_orderkey", "l_linenumber")


@query("sample_users", cte("fx_ratings") + "select user_id from (select distinct user_id from fx_ratings) "
       f"order by {seeded_int_sql('user_id', '0', 42)}, user_id limit 100")
def q_sample_users(spark, sf):
    """T-08: seeded sample of 100 users (seed 42)."""
    return ev.sample_users(Tables(spark, sf).ratings, 100, 42)


# ---------------------------------------------------------------- offline evaluation
_EVAL_USERS = "select user_id from holdout group by user_id having count(*) >= 2"


def _eval_recs(t, k):
    test = _holdout(t)
    users = ev.eval_users(test).select("user_id")
    _, _, profiles, vectors, counts, popular = qm._hybrid_inputs(t.spark, t.sf_dir)
    recs = hybrid.hybrid_recommend(users, profiles, vectors, counts, popular, t.movies,
                                   pop.movies_rated(t.movies), n=k)
    return test, recs


@query("offline_hit_rate", cte(*qm.HYBRID_FIXTURES, extra=_HOLDOUT + ",\n" + qm.hybrid_ctes(_EVAL_USERS, 30)) + """
select cast(count(*) as bigint) as n_users, cast(count(h.user_id) as bigint) as n_hits,
       round(case when count(*) > 0 then count(h.user_id) / count(*) else 0.0 end, 6) as hit_rate
from (""" + _EVAL_USERS + """) u left join (select distinct a.user_id from allr a join holdout t
      on a.user_id = t.user_id and a.movie_id = t.movie_id) h on u.user_id = h.user_id""")
def q_offline_hit_rate(spark, sf):
    t = Tables(spark, sf)
    test, recs = _eval_recs(t, ev.HIT_RATE_K)
    return _round6(ev.offline_hit_rate(recs, test))


@query("offline_rmse", cte("fx_ratings", extra=_HOLDOUT) +
       "select round(sqrt(avg(power(cast(rating as double) - 3.0, 2))), 6) as rmse, count(*) as n_ratings from holdout "
       "where user_id in (" + _EVAL_USERS + ")")
def q_offline_rmse(spark, sf):
    return _round6(ev.offline_rmse(_holdout(Tables(spark, sf))))


@query("rec_hits", cte(*qm.HYBRID_FIXTURES, extra=_HOLDOUT + ",\n" + qm.hybrid_ctes()) +
       "select a.user_id, a.rank, a.movie_id, exists (select 1 from holdout t where t.user_id = a.user_id "
       "and t.movie_id = a.movie_id) as hit from allr a")
def q_rec_hits(spark, sf):
    t = Tables(spark, sf)
    _, users, profiles, vectors, counts, popular = qm._hybrid_inputs(spark, sf)
    recs = hybrid.hybrid_recommend(users, profiles, vectors, counts, popular, t.movies, pop.movies_rated(t.movies))
    return ev.rec_hits(recs.select("user_id", "rank", "movie_id"), _holdout(t))


@query("user_movie_sets", cte("fx_ratings") +
       "select p.user_id, p.movie_id, s.n_movies from (select distinct user_id, movie_id from fx_ratings) p "
       "join (select user_id, count(distinct movie_id) as n_movies from fx_ratings group by user_id) s using (user_id)")
def q_user_movie_sets(spark, sf):
    return ev.user_movie_sets(Tables(spark, sf).ratings)


_POP = f"{qm._RATED}, {qm._PARAMS}, {qm._SCORED}, {qm._POPULAR}"


@query("popularity_accuracy", cte("fx_movies", extra=_POP) + """
select round(avg(case when hits > 0 then 1.0 else 0.0 end), 6) as hit_rate,
       round(avg(hits / 10.0), 6) as precision_at_k, count(*) as n_users
from (select u.user_id, count(p.movie_id) as hits
      from (select distinct user_id, movie_id from fx_ratings where rating is not null) u
      left join (select movie_id from popular where rank <= 10) p using (movie_id) group by u.user_id)""")
def q_popularity_accuracy(spark, sf):
    t = Tables(spark, sf)
    return _round6(ev.popularity_accuracy(pop.popular_movies(t.movies),
                                          t.ratings.where(F.col("rating").isNotNull()), 10))


@query("cf_accuracy", cte(*qm.HYBRID_FIXTURES, extra=qm.hybrid_ctes(k=10)) + """
select round(avg(case when hits > 0 then 1.0 else 0.0 end), 6) as hit_rate,
       round(sum(hits) / (10.0 * count(*)), 6) as precision_at_k, count(*) as n_users
from (select u.user_id, count(w.movie_id) as hits from (select distinct user_id from allr) u
      left join (select distinct user_id, movie_id from allr) r on r.user_id = u.user_id
      left join (select user_id, movie_id from fx_watch where watched_minutes >= 1) w
        on w.user_id = r.user_id and w.movie_id = r.movie_id
      group by u.user_id)""")
def q_cf_accuracy(spark, sf):
    t = Tables(spark, sf)
    _, users, profiles, vectors, counts, popular = qm._hybrid_inputs(spark, sf)
    recs = hybrid.hybrid_recommend(users, profiles, vectors, counts, popular, t.movies,
                                   pop.movies_rated(t.movies), n=10)
    return _round6(ev.cf_accuracy(recs, t.watch, 10))


_TEST_USERS = "firsts AS (select distinct user_id from holdout)"
_GLOBAL_RECS = "grecs AS (select f.user_id, p.rank, p.movie_id from firsts f cross join popular p where p.rank <= 10)"
_TEST_SET = _HOLDOUT + ",\n" + _TEST_USERS


def _first100_and_recs(t):
    """Test rows = the temporal holdout (every user in it); recommendations =
    the global popular top 10 for each of those users."""
    test = _holdout(t)
    recs = hybrid.get_recs(test.select("user_id"), pop.popular_movies(t.movies), 10, "global")
    return test, recs


@query("get_recs", cte("fx_movies", "fx_ratings", extra=f"{_POP}, {_TEST_SET}, {_GLOBAL_RECS}") +
       "select user_id, cast(rank as integer) as rank, movie_id from grecs")
def q_get_recs(spark, sf):
    t = Tables(spark, sf)
    _, recs = _first100_and_recs(t)
    return recs.select("user_id", F.col("rank").cast("int").alias("rank"), "movie_id")


@query("hr_at_k", cte("fx_movies", "fx_ratings", extra=f"{_POP}, {_TEST_SET}, {_GLOBAL_RECS}") + """
select round(avg(case when h.user_id is not null then 1.0 else 0.0 end), 6) as hr_at_k, count(*) as n_users
from (select distinct user_id from grecs) u left join
     (select distinct g.user_id from grecs g join holdout r on g.user_id = r.user_id and g.movie_id = r.movie_id) h
     on u.user_id = h.user_id""")
def q_hr_at_k(spark, sf):
    t = Tables(spark, sf)
    test, recs = _first100_and_recs(t)
    return _round6(ev.hr_at_k(recs, test))


@query("precision_at_k", cte("fx_movies", "fx_ratings", extra=f"{_POP}, {_TEST_SET}, {_GLOBAL_RECS}") + """
select round(coalesce(avg(hits / 10.0), 0.0), 6) as precision_at_k, count(*) as n_users
from (select g.user_id, sum(case when exists (select 1 from holdout r where r.user_id = g.user_id
                                           and r.movie_id = g.movie_id) then 1 else 0 end) as hits
      from grecs g group by g.user_id)""")
def q_precision_at_k(spark, sf):
    t = Tables(spark, sf)
    test, recs = _first100_and_recs(t)
    return _round6(ev.precision_at_k(recs, test, 10))


@query("rec_coverage", cte("fx_movies", "fx_watch", "fx_ratings", extra=f"{qm._CONTENT}, {_TEST_SET}") + """
select (select count(*) from firsts) as n_test_users,
       (select count(distinct user_id) from prof) as n_model_users,
       (select count(*) from firsts where user_id not in (select user_id from prof)) as n_missing_users,
       (select count(*) from firsts where user_id not in (select user_id from prof)) as n_empty_lists""")
def q_rec_coverage(spark, sf):
    """A-26 for the per-user content model over every test (holdout) user:
    users without a profile get no list."""
    t = Tables(spark, sf)
    test = _holdout(t)
    _, profiles, vectors, _ = qm._content_inputs(spark, sf)
    recs = hybrid.content_recs(profiles.join(test.select("user_id").distinct(), "user_id", "left_semi"), vectors,
                               pop.movies_rated(t.movies), t.movies)
    return ev.rec_coverage(test, profiles, recs)


@query("watch_truth", cte("fx_ratings", "fx_watch") +
       "select r.user_id, r.movie_id, r.rating, r.l_orderkey, r.l_linenumber, w.watched_minutes, "
       "coalesce(w.watched_minutes >= 5, false) as truth from fx_ratings r "
       "left join fx_watch w on r.user_id = w.user_id and r.movie_id = w.movie_id")
def q_watch_truth(spark, sf):
    t = Tables(spark, sf)
    return ev.watch_truth(t.ratings, t.watch).select("user_id", "movie_id", "rating", "l_orderkey",
                                                     "l_linenumber", "watched_minutes", "truth")


# ---------------------------------------------------------------- set operations
@query("union_chunks", cte("fx_ratings", "fx_watch") +
       "select 'rating' as kind, user_id, movie_id, updated_at from fx_ratings "
       "union all select 'watch', user_id, movie_id, updated_at from fx_watch")
def q_union_chunks(spark, sf):
    """U-01: several sources of (user, movie, time) rows as one frame."""
    t = Tables(spark, sf)
    return (t.ratings.select(F.lit("rating").alias("kind"), "user_id", "movie_id", "updated_at")
            .unionByName(t.watch.select(F.lit("watch").alias("kind"), "user_id", "movie_id", "updated_at")))


@query("intersect_hits", cte("fx_movies", "fx_ratings", extra=f"{_POP}, {_TEST_SET}, {_GLOBAL_RECS}") +
       "select user_id, movie_id from grecs intersect select user_id, movie_id from holdout")
def q_intersect_hits(spark, sf):
    """U-03: recommended ∩ actually rated (test rows), per user."""
    t = Tables(spark, sf)
    test, recs = _first100_and_recs(t)
    return recs.select("user_id", "movie_id").intersect(test.select("user_id", "movie_id"))


@query("except_users", cte("fx_movies", "fx_watch", "fx_ratings", extra=f"{qm._CONTENT}, {_HOLDOUT}") +
       "select user_id from holdout except select user_id from prof")
def q_except_users(spark, sf):
    """U-04: test users − model users."""
    t = Tables(spark, sf)
    _, profiles, _, _ = qm._content_inputs(spark, sf)
    return _holdout(t).select("user_id").subtract(profiles.select("user_id"))


# ---------------------------------------------------------------- scalar helpers on real rows


@query("clip_prediction", cte("fx_ratings", "fx_watch", "fx_user_factors", "fx_item_factors", extra=_HOLDOUT) + """
select h.user_id, h.movie_id, round(least(greatest(coalesce(p.cf, 3.0), 1.0), 5.0), 6) as prediction
from (select distinct user_id, movie_id from holdout) h left join
     (select u.user_id, v.movie_id, sum(u.value * v.value) as cf from fx_user_factors u join fx_item_factors v using (dim)
      where u.user_id in (select user_id from fx_watch) group by 1, 2) p
     on p.user_id = h.user_id and p.movie_id = h.movie_id""")
def q_clip_prediction(spark, sf):
    """P-27: CF predictions (factors known only for users with watch events)
    defaulted to 3.0 and clipped to [1, 5]."""
    t = Tables(spark, sf)
    pairs = _holdout(t).select("user_id", "movie_id").distinct()
    uf = t.user_factors.join(t.watch.select("user_id").distinct(), "user_id", "left_semi")
    p = cf.cf_scores(pairs, uf, t.item_factors)
    return (pairs.join(p, ["user_id", "movie_id"], "left")
            .select("user_id", "movie_id", F.round(clip_prediction("cf_score"), 6).alias("prediction")))


@query("title_or_unknown", cte("fx_movies", "fx_log", extra=qi._PARSED_KEYS)
       + ", ids AS (select movie_id from fx_movies union all select movie_id from newk) "
         "select ids.movie_id, coalesce(m.movie_title_id, concat('Unknown Title (', cast(ids.movie_id as varchar), ')')) "
         "as title from ids left join fx_movies m using (movie_id)")
def q_title_or_unknown(spark, sf):
    """P-28: titles for catalogue ids and for ids created from the log (new
    movies have no title row yet → ``Unknown Title (<id>)``)."""
    t = Tables(spark, sf)
    log = t.log
    facts = parsing.parse_watch(log).select("movie_title_id").unionByName(parsing.parse_rate(log).select("movie_title_id"))
    new = dimensions.new_movie_keys(facts, t.movies.select("movie_id", "movie_title_id"))
    ids = t.movies.select("movie_id").unionByName(new.select("movie_id"))
    titled = ids.join(hybrid.title_map(t.movies), "movie_id", "left")
    return titled.select("movie_id", title_or_unknown(F.col("title"), F.col("movie_id")).alias("title"))


@query("hybrid_scores", cte(*qm.CF_FIXTURES, extra=_HOLDOUT + ",\n" + qm.hybrid_ctes(
    "select distinct user_id from holdout", with_cf=False)) + """
, hpairs AS (select distinct user_id, movie_id from holdout),
cfp AS (select p.user_id, p.movie_id, sum(u.value * v.value) as cf from hpairs p join fx_user_factors u on u.user_id = p.user_id
        join fx_item_factors v on v.movie_id = p.movie_id and v.dim = u.dim group by 1, 2),
cbp AS (select p.user_id, p.movie_id, sc.score as cb from hpairs p join sc on sc.user_id = p.user_id and sc.movie_id = p.movie_id)
select b.user_id, b.movie_id, round(wt.alpha * b.cf + wt.beta * b.cb, 6) as score from (
  select coalesce(cfp.user_id, cbp.user_id) as user_id, coalesce(cfp.movie_id, cbp.movie_id) as movie_id,
         coalesce(cfp.cf, 0.0) as cf, coalesce(cbp.cb, 0.0) as cb
  from cfp full outer join cbp on cfp.user_id = cbp.user_id and cfp.movie_id = cbp.movie_id) b
join wt using (user_id) where wt.alpha * b.cf + wt.beta * b.cb > 0""")
def q_hybrid_scores(spark, sf):
    """J-15 on requested (user, movie) pairs (the holdout): CF and CB aligned
    by a full outer join, missing side 0, ``α·cf + β·cb``, keep > 0."""
    t = Tables(spark, sf)
    pairs = _holdout(t).select("user_id", "movie_id").distinct()
    _, _, profiles, vectors, counts, _ = qm._hybrid_inputs(spark, sf)
    cfp = cf.cf_scores(pairs, t.user_factors, t.item_factors)
    from ..operators import content as ct
    cbp = ct.cb_scores_of(pairs, profiles, vectors)
    w = hybrid.hybrid_weights(pairs.select("user_id"), profiles, counts)
    return hybrid.hybrid_scores(cfp, cbp, w).select("user_id", "movie_id", F.round("score", 6).alias("score"))
