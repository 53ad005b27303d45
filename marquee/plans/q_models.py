"""Registered queries: model operators (popularity, content, collaborative, hybrid)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables, cte
from ..functions import genres as G
from ..operators import content, hybrid, scoring
from ..operators import popularity as pop
from .registry import query

_RATED = "rated AS (select movie_id, title, rating, votes, genres from fx_movies where rating is not null and votes is not null)"
_PARAMS = "params AS (select avg(rating) as mean_rating, quantile_cont(votes, 0.9) as min_votes from rated)"
_SCORED = ("scored AS (select movie_id, round(cast(votes as double)/(votes+min_votes)*rating"
           " + min_votes/(votes+min_votes)*mean_rating, 6) as popularity_score from rated, params)")
_POPULAR = ("popular AS (select cast(row_number() over (order by popularity_score desc, movie_id) as integer) as rank,"
            " movie_id, popularity_score from scored order by popularity_score desc, movie_id limit 50)")


@query("movies_rated", cte("fx_movies") + "select movie_id, title, rating, votes, genres from fx_movies "
       "where rating is not null and votes is not null", text_arrays=("genres",))
def q_movies_rated(spark, sf):
    return pop.movies_rated(Tables(spark, sf).movies)


@query("popularity_params", cte("fx_movies", extra=f"{_RATED}, {_PARAMS}") +
       "select round(mean_rating, 6) as mean_rating, round(min_votes, 6) as min_votes from params")
def q_popularity_params(spark, sf):
    p = pop.popularity_params(Tables(spark, sf).movies)
    return p.select(F.round("mean_rating", 6).alias("mean_rating"), F.round("min_votes", 6).alias("min_votes"))


@query("bayesian_score", cte("fx_movies", extra=f"{_RATED}, {_PARAMS}, {_SCORED}") + "select * from scored")
def q_bayesian_score(spark, sf):
    return pop.bayesian_score(Tables(spark, sf).movies)


@query("popular_movies", cte("fx_movies", extra=f"{_RATED}, {_PARAMS}, {_SCORED}, {_POPULAR}")
       + "select * from popular")
def q_popular_movies(spark, sf):
    return pop.popular_movies(Tables(spark, sf).movies)


@query("popularity_model", cte("fx_movies", extra=f"{_RATED}, {_PARAMS}, {_SCORED}, {_POPULAR}")
       + "select * from popular")
def q_popularity_model(spark, sf):
    return pop.popular_movies(Tables(spark, sf).movies, pop.POPULAR_TOP_N)


@query("popular_prefix", cte("fx_movies", extra=f"{_RATED}, {_PARAMS}, {_SCORED}, {_POPULAR}")
       + "select * from popular where rank <= 20")
def q_popular_prefix(spark, sf):
    return pop.popular_prefix(pop.popular_movies(Tables(spark, sf).movies), 20)


@query("popular_details", cte("fx_movies", extra=f"{_RATED}, {_PARAMS}, {_SCORED}, {_POPULAR}")
       + "select movie_id, movie_title_id, title, year, rating, votes from fx_movies "
         "where movie_id in (select movie_id from popular)")
def q_popular_details(spark, sf):
    t = Tables(spark, sf)
    return pop.popular_details(t.movies, pop.popular_movies(t.movies)).drop("genres")


# ====================================================================== content model


_STD = "translate(lower(trim({x})), ' -', '__')"
_CONTENT = f"""
wg AS (select w.* from fx_watch w join fx_movies m using (movie_id) where m.genres is not null),
mg AS (select distinct movie_id, {_STD.format(x='g')} as genre
       from (select movie_id, unnest(genres) as g from fx_movies where genres is not null)
       where g is not null and {_STD.format(x='g')} <> ''),
pairs AS (select user_id, movie_id, count(*) as f,
                 sum(coalesce(1.0 / (1.0 + exp(-0.05 * (cast(watched_minutes as double) - 40.0))), 0.0)) as s
          from wg group by user_id, movie_id),
raw AS (select user_id, genre, sum(f * s) as raw_weight from pairs join mg using (movie_id) group by user_id, genre),
prof AS (select user_id, genre, raw_weight / t as weight
         from (select *, sum(raw_weight) over (partition by user_id) as t from raw) where t > 0 and raw_weight > 0),
vocab AS (select distinct genre from mg where movie_id in (select movie_id from wg)),
{_RATED},
vec AS (select movie_id, genre, 1.0 / count(*) over (partition by movie_id) as weight
        from mg where movie_id in (select movie_id from rated) and genre in (select genre from vocab)),
sc AS (select user_id, movie_id, sum(p.weight * v.weight) as score from prof p join vec v using (genre)
       group by user_id, movie_id)"""


def _content_inputs(spark, sf):
    t = Tables(spark, sf)
    profiles, vectors, vocab = content.content_model(t.watch, t.movies)
    return t, profiles, vectors, vocab


@query("watch_chunk_genres", cte("fx_movies", "fx_watch") +
       "select w.watch_id, w.user_id, w.movie_id from fx_watch w join fx_movies m using (movie_id) where m.genres is not null")
def q_watch_chunk_genres(spark, sf):
    t = Tables(spark, sf)
    return content.watch_with_genres(t.watch, t.movies).select("watch_id", "user_id", "movie_id")


@query("watch_frequency", cte("fx_watch") + "select watch_id, user_id, movie_id, "
       "count(*) over (partition by user_id, movie_id) as watch_frequency from fx_watch")
def q_watch_frequency(spark, sf):
    return content.watch_frequency(Tables(spark, sf).watch).select("watch_id", "user_id", "movie_id",
                                                                   "watch_frequency")


@query("std_genre", cte("fx_movies") + f"select distinct g as raw_genre, {_STD.format(x='g')} as genre "
       "from (select unnest(genres) as g from fx_movies where genres is not null)")
def q_std_genre(spark, sf):
    m = Tables(spark, sf).movies
    raw = m.select(F.explode("genres").alias("raw_genre")).distinct()
    return raw.select("raw_genre", G.std_genre("raw_genre").alias("genre"))


@query("genres_from_array", cte("fx_movies") + f"""
select movie_id, genre, cast(row_number() over (partition by movie_id order by min(i)) as integer) as pos
from (select movie_id, {_STD.format(x='g')} as genre, i
      from (select movie_id, unnest(genres) as g, unnest(generate_series(1, len(genres))) as i
            from fx_movies where genres is not null) where g is not null)
where genre <> '' group by movie_id, genre""")
def q_genres_from_array(spark, sf):
    m = Tables(spark, sf).movies
    return (m.select("movie_id", F.posexplode(G.genres_from_array("genres")).alias("p", "genre"))
            .select("movie_id", "genre", (F.col("p") + 1).cast("int").alias("pos")))


@query("genres_from_string", cte("fx_meta") + f"""
select movie_id, genre, cast(row_number() over (partition by movie_id order by min(i)) as integer) as pos
from (select movie_id, {_STD.format(x='g')} as genre, i
      from (select movie_id, unnest(l) as g, unnest(generate_series(1, len(l))) as i
            from (select movie_id, regexp_split_to_array(genres, '[,\\s]+') as l from fx_meta where genres is not null)))
where genre <> '' group by movie_id, genre""")
def q_genres_from_string(spark, sf):
    m = Tables(spark, sf).meta
    return (m.select("movie_id", F.posexplode(G.genres_from_string("genres")).alias("p", "genre"))
            .select("movie_id", "genre", (F.col("p") + 1).cast("int").alias("pos")))


@query("watch_weight", cte("fx_watch") + "select watch_id, round(coalesce(1.0 / (1.0 + exp(-0.05 * "
       "(cast(watched_minutes as double) - 40.0))), 0.0), 6) as weight from fx_watch")
def q_watch_weight(spark, sf):
    w = Tables(spark, sf).watch
    return w.select("watch_id", F.round(G.watch_weight("watched_minutes"), 6).alias("weight"))


@query("genre_vocab", cte("fx_movies", "fx_watch", extra=_CONTENT) + "select genre from vocab")
def q_genre_vocab(spark, sf):
    t = Tables(spark, sf)
    return content.genre_vocab(content.watch_with_genres(t.watch, t.movies), t.movies)


@query("genre_onehot", cte("fx_movies", "fx_watch", extra=_CONTENT) +
       "select movie_id, genre, 1 as indicator from mg where genre in (select genre from vocab)")
def q_genre_onehot(spark, sf):
    t = Tables(spark, sf)
    vocab = content.genre_vocab(content.watch_with_genres(t.watch, t.movies), t.movies)
    return (content.movie_genres(t.movies).join(vocab, "genre", "left_semi")
            .select("movie_id", "genre", F.lit(1).alias("indicator")))


@query("user_profiles_raw", cte("fx_movies", "fx_watch", extra=_CONTENT) +
       "select user_id, genre, round(raw_weight, 6) as raw_weight from raw")
def q_user_profiles_raw(spark, sf):
    t = Tables(spark, sf)
    raw = content.user_profiles_raw(content.watch_with_genres(t.watch, t.movies), t.movies)
    return raw.select("user_id", "genre", F.round("raw_weight", 6).alias("raw_weight"))


@query("user_profiles", cte("fx_movies", "fx_watch", extra=_CONTENT) +
       "select user_id, genre, round(weight, 6) as weight from prof")
def q_user_profiles(spark, sf):
    _, profiles, _, _ = _content_inputs(spark, sf)
    return profiles.select("user_id", "genre", F.round("weight", 6).alias("weight"))


@query("movie_vectors", cte("fx_movies", "fx_watch", extra=_CONTENT) +
       "select movie_id, genre, round(weight, 6) as weight from vec")
def q_movie_vectors(spark, sf):
    _, _, vectors, _ = _content_inputs(spark, sf)
    return vectors.select("movie_id", "genre", F.round("weight", 6).alias("weight"))


@query("vectors_float32", cte("fx_movies", "fx_watch", extra=_CONTENT) +
       "select movie_id, genre, cast(weight as float) as weight from vec")
def q_vectors_float32(spark, sf):
    _, _, vectors, _ = _content_inputs(spark, sf)
    return vectors.select("movie_id", "genre", F.col("weight").cast("float").alias("weight"))


@query("content_model", cte("fx_movies", "fx_watch", extra=_CONTENT) +
       "select 'user' as kind, user_id as id, genre, round(weight, 6) as weight from prof "
       "union all select 'movie', movie_id, genre, round(weight, 6) from vec")
def q_content_model(spark, sf):
    _, profiles, vectors, _ = _content_inputs(spark, sf)
    return (profiles.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "genre",
                            F.round("weight", 6).alias("weight"))
            .unionByName(vectors.select(F.lit("movie").alias("kind"), F.col("movie_id").alias("id"), "genre",
                                        F.round("weight", 6).alias("weight"))))


@query("cb_scores", cte("fx_movies", "fx_watch", extra=_CONTENT) +
       "select user_id, movie_id, round(score, 6) as score from sc")
def q_cb_scores(spark, sf):
    _, profiles, vectors, _ = _content_inputs(spark, sf)
    return content.cb_scores(profiles, vectors, decimals=6)


_CONTENT_RECS = f"""{_CONTENT},
allp AS (select u.user_id, r.movie_id, coalesce(sc.score, 0.0) as score
         from (select distinct user_id from prof) u cross join (select movie_id from rated) r
         left join sc on sc.user_id = u.user_id and sc.movie_id = r.movie_id),
ranked AS (select *, row_number() over (partition by user_id order by round(score, 6) desc, movie_id) as rk from allp)"""


@query("content_recs", cte("fx_movies", "fx_watch", extra=_CONTENT_RECS) +
       "select user_id, cast(rk as integer) as rank, movie_id, movie_title_id as title, round(score, 6) as score "
       "from ranked join fx_movies using (movie_id) where rk <= 20")
def q_content_recs(spark, sf):
    t, profiles, vectors, _ = _content_inputs(spark, sf)
    return hybrid.content_recs(profiles, vectors, pop.movies_rated(t.movies), t.movies, 20)


_SIMILAR = f"""{_CONTENT},
ss AS (select a.movie_id as query_movie_id, b.movie_id, sum(a.weight * b.weight) as score
       from vec a join vec b using (genre) where a.movie_id <> b.movie_id group by 1, 2),
allq AS (select q.movie_id as query_movie_id, r.movie_id, coalesce(ss.score, 0.0) as score
         from rated q join rated r on q.movie_id <> r.movie_id
         left join ss on ss.query_movie_id = q.movie_id and ss.movie_id = r.movie_id),
rq AS (select *, row_number() over (partition by query_movie_id order by round(score, 6) desc, movie_id) as rk from allq)"""


@query("similar_movies", cte("fx_movies", "fx_watch", extra=_SIMILAR) +
       "select query_movie_id, cast(rk as integer) as rank, movie_id, round(score, 6) as score from rq where rk <= 5")
def q_similar_movies(spark, sf):
    t, _, vectors, _ = _content_inputs(spark, sf)
    return hybrid.similar_movies(vectors, pop.movies_rated(t.movies), 5)


# ====================================================================== hybrid
_HYBRID_BASE = f"""{_CONTENT},
{_PARAMS}, {_SCORED}, {_POPULAR},
cnt AS (select user_id, count(rating) as n_rated from fx_ratings group by user_id),
req AS ({{REQ}}),
known AS (select user_id from prof union select user_id from cnt),
w AS (select r.user_id, case when k.user_id is not null then coalesce(c.n_rated, 0) else 0 end as n
      from req r left join known k on r.user_id = k.user_id left join cnt c on r.user_id = c.user_id),
wt AS (select user_id, n,
              cast(case when n >= 20 then 0.8 when n >= 10 then 0.6 when n >= 1 then 0.4 else 0.0 end as double) as alpha,
              cast(case when n >= 20 then 0.2 when n >= 10 then 0.4 when n >= 1 then 0.6 else 1.0 end as double) as beta
       from w)"""

_HYBRID_TAIL = """
hr AS (select *, row_number() over (partition by user_id order by round(score, 6) desc, movie_id) as rk from hyb),
top AS (select user_id, cast(rk as integer) as rank, movie_id, score, 'hybrid' as source from hr where rk <= {{K}}),
fb AS (select wt.user_id, p.rank, p.movie_id, p.popularity_score as score, 'popular' as source
       from wt cross join popular p where p.rank <= {{K}} and wt.user_id not in (select user_id from top)),
allr AS (select * from top union all select * from fb)"""

REQ_ALL = "select c_custkey as user_id from customer union select user_id from fx_watch"
_CB_ONLY = (",\nhyb AS (select s.user_id, s.movie_id, wt.beta * s.score as score from sc s join wt using (user_id) "
            "where wt.beta * s.score > 0),")


def hybrid_ctes(req: str = REQ_ALL, k: int = 20, with_cf: bool = False) -> str:
    """Oracle CTEs ending in ``allr(user_id, rank, movie_id, score, source)``."""
    body = _HYBRID_BASE + (_HYBRID_CF if with_cf else _CB_ONLY) + _HYBRID_TAIL
    return body.replace("{{REQ}}", req).replace("{REQ}", req).replace("{{K}}", str(k))


HYBRID_FIXTURES = ("fx_movies", "fx_watch", "fx_ratings")
CF_FIXTURES = HYBRID_FIXTURES + ("fx_user_factors", "fx_item_factors")

_HYBRID_SELECT = ("select a.user_id, a.rank, a.movie_id, coalesce(m.movie_title_id, concat('Unknown Title (', "
                  "cast(a.movie_id as varchar), ')')) as title, round(a.score, 6) as score, a.source "
                  "from allr a left join fx_movies m using (movie_id)")


def _hybrid_inputs(spark, sf):
    t, profiles, vectors, _ = _content_inputs(spark, sf)
    users = t.customer.select(F.col("c_custkey").alias("user_id")).union(t.watch.select("user_id")).distinct()
    counts = hybrid.rating_counts(t.ratings)
    popular = pop.popular_movies(t.movies)
    return t, users, profiles, vectors, counts, popular


@query("hybrid_cb_only", cte(*HYBRID_FIXTURES, extra=hybrid_ctes()) + _HYBRID_SELECT)
def q_hybrid_cb_only(spark, sf):
    t, users, profiles, vectors, counts, popular = _hybrid_inputs(spark, sf)
    return hybrid.hybrid_recommend(users, profiles, vectors, counts, popular, t.movies,
                                   pop.movies_rated(t.movies))


_HYBRID_CF = """,
cf AS (select u.user_id, i.movie_id, sum(u.value * i.value) as cf from fx_user_factors u
       join fx_item_factors i using (dim) where i.movie_id in (select movie_id from rated) group by 1, 2),
both_ AS (select coalesce(cf.user_id, sc.user_id) as user_id, coalesce(cf.movie_id, sc.movie_id) as movie_id,
                 coalesce(cf.cf, 0.0) as cf, coalesce(sc.score, 0.0) as cb
          from cf full outer join sc on cf.user_id = sc.user_id and cf.movie_id = sc.movie_id),
hyb AS (select b.user_id, b.movie_id, wt.alpha * b.cf + wt.beta * b.cb as score from both_ b join wt using (user_id)
        where wt.alpha * b.cf + wt.beta * b.cb > 0),"""


@query("hybrid_recommend", cte(*CF_FIXTURES, extra=hybrid_ctes(with_cf=True)) + _HYBRID_SELECT)
def q_hybrid_recommend(spark, sf):
    t, users, profiles, vectors, counts, popular = _hybrid_inputs(spark, sf)
    return hybrid.hybrid_recommend(users, profiles, vectors, counts, popular, t.movies,
                                   pop.movies_rated(t.movies), t.user_factors, t.item_factors)


@query("hybrid_weights", cte(*HYBRID_FIXTURES, extra=hybrid_ctes()) +
       "select user_id, cast(n as bigint) as n_rated, alpha, beta from wt")
def q_hybrid_weights(spark, sf):
    t, users, profiles, vectors, counts, popular = _hybrid_inputs(spark, sf)
    return hybrid.hybrid_weights(users, profiles, counts)


@query("known_users", cte(*HYBRID_FIXTURES, extra=hybrid_ctes()) + "select user_id from known")
def q_known_users(spark, sf):
    t, users, profiles, vectors, counts, popular = _hybrid_inputs(spark, sf)
    return hybrid.known_users(profiles, counts)


@query("user_rating_count", cte("fx_ratings") + "select user_id, count(rating) as n_rated from fx_ratings group by 1")
def q_user_rating_count(spark, sf):
    return hybrid.rating_counts(Tables(spark, sf).ratings)


@query("title_map", cte("fx_movies") + "select movie_id, movie_title_id as title from fx_movies")
def q_title_map(spark, sf):
    return hybrid.title_map(Tables(spark, sf).movies)


@query("popularity_fallback", cte(*HYBRID_FIXTURES, extra=hybrid_ctes()) +
       "select user_id, rank, movie_id, round(score, 6) as score from fb")
def q_popularity_fallback(spark, sf):
    t, users, profiles, vectors, counts, popular = _hybrid_inputs(spark, sf)
    scored = profiles.select("user_id").distinct()   # every profiled user has a positive score
    fb = hybrid.popularity_fallback(users, scored, popular)
    return fb.select("user_id", "rank", "movie_id", F.round("score", 6).alias("score"))


# ====================================================================== generic top-N and dense vectors
@query("top_n_per_user", cte("fx_ratings") + """
select user_id, cast(rk as integer) as rank, movie_id, r from (
  select user_id, movie_id, r, row_number() over (partition by user_id order by round(r, 6) desc, movie_id) as rk
  from (select user_id, movie_id, cast(sum(rating) as double) as r from fx_ratings where rating is not null
        group by user_id, movie_id)) where rk <= 3""")
def q_top_n_per_user(spark, sf):
    """W-03: per-user top 3 cells by summed rating, ties by id (group-limited)."""
    from ..operators.collaborative import user_item_matrix
    cells = user_item_matrix(Tables(spark, sf).ratings)
    return scoring.top_n_per_key(cells, "user_id", "r", "movie_id", 3).select("user_id", "rank", "movie_id", "r")


@query("similar_vectors", """
select query_id, cast(rk as integer) as rank, vec_id, round(score, 6) as score from (
  select a.vec_id as query_id, b.vec_id, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) as score,
         row_number() over (partition by a.vec_id order by round(list_dot_product(cast(a.embedding as double[]),
                                                                 cast(b.embedding as double[])), 6) desc, b.vec_id) as rk
  from embeddings a join embeddings b on a.vec_id <> b.vec_id) where rk <= 5""")
def q_similar_vectors(spark, sf):
    """M-03 dense form over the embeddings table: 5 nearest others by dot
    product (self excluded, ties by id), blocked matrix products."""
    e = Tables(spark, sf).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    top = scoring.topk_dot(e.select(F.col("vec_id").alias("query_id"), "vec"), "query_id",
                           e.withColumn("tie", F.col("vec_id")), "vec_id", "tie", 5, exclude_self=True)
    return top.select("query_id", "rank", F.col("item_id").alias("vec_id"), F.round("score", 6).alias("score"))
