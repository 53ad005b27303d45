"""Genre content model (M-02): profiles, vectors, vocabulary, scores (A-05 … A-07,
A-10, W-01, P-23, J-13).

Everything is long form ``(id, genre, weight)``: the wide one-column-per-genre
frames of the reference would give a schema that changes with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genres import genres_from_array, watch_weight
from ..session import materialize_many
from .popularity import movies_rated

WEIGHT_DP = 6
# Movies of a signature in one array, on average.
MEMBERS = 1024


def watch_with_genres(watch: DataFrame, movies: DataFrame) -> DataFrame:
    """J-01 without paging: watch rows of movies whose genres are present."""
    m = movies.where(F.col("genres").isNotNull()).select("movie_id", "genres")
    return watch.join(m, "movie_id")


def watch_frequency(watch: DataFrame) -> DataFrame:
    """W-01: rows per (user, movie) repeated on every watch row.

    A partial count per pair joined back by key instead of a window that would hold
    a hot pair in one task.  The counts are written first, so the join is between plain
    shuffles and AQE splits a hot pair on the large side.
    """
    freq = materialize_many([(watch.groupBy("user_id", "movie_id").agg(F.count(F.lit(1)).alias("watch_frequency")), "watch-freq")])[0]
    return watch.join(freq, ["user_id", "movie_id"])


def movie_genres(movies: DataFrame) -> DataFrame:
    """P-18 exploded: ``(movie_id, genre)`` for movies with genres present."""
    return (movies.where(F.col("genres").isNotNull())
            .select("movie_id", F.explode(genres_from_array("genres")).alias("genre")))


def genre_vocab(watch: DataFrame, movies: DataFrame) -> DataFrame:
    """A-10: distinct standardised genres of watched movies (genres present)."""
    watched = watch.select("movie_id").distinct()
    return movie_genres(movies.join(watched, "movie_id", "left_semi")).select("genre").distinct()


def user_profiles_raw(watch: DataFrame, movies: DataFrame) -> DataFrame:
    """A-05: ``raw(u, g) = Σ_rows [g ∈ genres(m)] · σ(minutes) · f(u, m)``.

    Rewritten as ``Σ_m [g ∈ genres(m)] · f(u, m) · Σ_rows(u,m) σ`` so the only
    per-row work is one partial aggregate per (user, movie); the genre
    expansion then joins one row per pair, not one per view.
    """
    pairs = (watch.groupBy("user_id", "movie_id")
             .agg(F.count(F.lit(1)).alias("f"), F.sum(watch_weight("watched_minutes")).alias("s")))
    mg = movie_genres(movies.join(watch.select("movie_id").distinct(), "movie_id", "left_semi"))
    return (pairs.join(mg, "movie_id")
            .groupBy("user_id", "genre")
            .agg(F.sum(F.col("f") * F.col("s")).alias("raw_weight")))


def user_profiles(watch: DataFrame, movies: DataFrame) -> DataFrame:
    """A-06 on users: L1-normalised profile; all-zero users vanish (0/0 → 0).

    After A-05 a user has at most |vocabulary| rows, so the per-user window is
    bounded by the vocabulary, not by how much the user watched.
    """
    raw = user_profiles_raw(watch, movies)
    total = F.sum("raw_weight").over(Window.partitionBy("user_id"))
    return (raw.withColumn("_t", total)
            .where((F.col("_t") > 0) & (F.col("raw_weight") > 0))
            .select("user_id", "genre", (F.col("raw_weight") / F.col("_t")).alias("weight")))


def movie_vectors(movies: DataFrame, vocab: DataFrame) -> DataFrame:
    """A-07: ``1/|genres(m) ∩ vocab|`` per in-vocabulary genre of each rated movie.

    The universe is the rated movies (S-09 source); movies without any
    in-vocabulary genre have no rows (their scores are 0).
    """
    rated = movies_rated(movies)
    mg = movie_genres(rated).join(vocab, "genre", "left_semi")
    n = F.count(F.lit(1)).over(Window.partitionBy("movie_id"))  # ≤ genres per movie
    return mg.select("movie_id", "genre", (F.lit(1.0) / n).alias("weight"))


def content_model(watch: DataFrame, movies: DataFrame, write_model: bool = True):
    """M-02: (profiles, vectors, vocabulary) from watch rows with genres.

    The trained model is written once into the shared checkpoint folder (the
    reference pickled it): every later step — the
    vocabulary and candidate blocks read on the driver, the scoring job —
    reads these files instead of re-running the aggregation, and a lost
    executor does not send recomputation back to the raw watch log.
    """
    wg = watch_with_genres(watch, movies)
    vocab = genre_vocab(wg, movies)
    profiles, vectors = user_profiles(wg, movies), movie_vectors(movies, vocab)
    if write_model:
        profiles, vectors = materialize_many([(profiles, "profiles"), (vectors, "vectors")])
        vocab = vectors.select("genre").union(profiles.select("genre")).distinct()
    return profiles, vectors, vocab


def cb_scores(profiles: DataFrame, vectors: DataFrame, decimals: int | None = None) -> DataFrame:
    """J-13: every (user, movie) pair with a positive dot product (all other
    pairs score 0); scores rounded to ``decimals`` if given.

    Movies with the same genre set share a vector, so users are scored
    per signature with blocked matrix products (no (user, movie, genre)
    triples are ever formed).  The signature's movies, as arrays of about
    ``MEMBERS`` ids, go into the scoring tasks beside its vector; a score leaves a task
    with such an array, is rounded there once and expanded: that expansion is the output,
    and no row of it, nor of the scores, is joined, shuffled or kept on disk.
    """
    from . import scoring   # local import: scoring imports nothing from here

    sig_vec, members = signatures(vectors)
    sig_vec, members = materialize_many([(sig_vec, "sig-vectors"), (members, "sig-members")])
    q = scoring.to_sparse(profiles, "user_id", "genre", "weight")
    items = scoring.to_sparse(sig_vec.withColumnRenamed("min_movie_id", "item_id"), "item_id", "genre", "weight")
    of = members.groupBy("sig").agg(F.min("movie_id").alias("item_id"), F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    # structs, as a list of plain ids would lose a null one
    lists = members.join(of, "sig").groupBy("item_id", F.pmod(F.xxhash64("movie_id"), "parts").alias("part")) \
        .agg(F.transform(F.collect_list(F.struct("movie_id")), lambda m: m["movie_id"]).alias("members"))
    scored = scoring.dot_lists(q, "user_id", items, "item_id", lists)
    if decimals is not None:
        scored = scored.withColumn("score", F.round("score", decimals))
    return scored.select("user_id", F.explode("members").alias("movie_id"), "score")


def cb_scores_of(pairs: DataFrame, profiles: DataFrame, vectors: DataFrame) -> DataFrame:
    """J-13 on requested (user, movie) pairs: their positive dot products, without the
    other pairs of :func:`cb_scores`."""
    from . import scoring

    return scoring.pair_dot(pairs, profiles, "user_id", vectors, "movie_id", "genre", "weight").where("score > 0")


def signatures(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group movies with identical genre sets (hence identical vectors).

    Returns ``(sig_vectors (sig, genre, weight, min_movie_id), sig_members (sig, movie_id))``.
    The signature key is the sorted genre list as text.
    """
    per_movie = vectors.groupBy("movie_id").agg(
        F.concat_ws("\u0001", F.sort_array(F.collect_list("genre"))).alias("sig"))
    members = per_movie.select("sig", "movie_id")
    first = members.groupBy("sig").agg(F.min("movie_id").alias("min_movie_id"))
    # one movie per signature is picked first, so a signature of many movies is no hot join key
    sig_vec = (vectors.join(first.withColumnRenamed("min_movie_id", "movie_id"), "movie_id")
               .select("sig", "genre", "weight", F.col("movie_id").alias("min_movie_id")))
    return sig_vec, members
