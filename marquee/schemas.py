"""Schemas of the domain tables and file formats (§1 of the blueprint)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
D = T.DoubleType()
TS = T.TimestampNTZType()
ARR = T.ArrayType(T.StringType())

MOVIES = T.StructType([
    T.StructField("movie_id", L), T.StructField("imdb_id", S),
    T.StructField("movie_title_id", S), T.StructField("title", S),
    T.StructField("year", I), T.StructField("rating", D), T.StructField("genres", ARR),
    T.StructField("plot", S), T.StructField("duration", I), T.StructField("directors", ARR),
    T.StructField("actors", ARR), T.StructField("votes", I), T.StructField("languages", ARR),
    T.StructField("country", ARR), T.StructField("release_date", T.DateType()),
    T.StructField("poster", S),
])

USERS = T.StructType([T.StructField("user_id", L)])

RATINGS = T.StructType([
    T.StructField("rating_id", L), T.StructField("user_id", L), T.StructField("movie_id", L),
    T.StructField("rating", I), T.StructField("updated_at", TS),
])

WATCH_HISTORY = T.StructType([
    T.StructField("watch_id", L), T.StructField("updated_at", TS), T.StructField("user_id", L),
    T.StructField("movie_id", L), T.StructField("watched_minutes", I),
])

# Headerless raw log CSV: time, user id, request text.
LOG_CSV = T.StructType([
    T.StructField("timestamp", S), T.StructField("request_id", S), T.StructField("request", S),
])

# Metadata CSV as written by the enrichment step (all text until cleaned).
MOVIE_METADATA_CSV_COLUMNS = ["movie_id", "movie_title_id", "title", "year", "rating", "genres", "plot",
                              "runtime", "directors", "cast", "votes", "languages", "country",
                              "release_date", "poster"]


def all_string(columns) -> T.StructType:
    return T.StructType([T.StructField(c, S) for c in columns])


TABLE_SCHEMAS = {"movies": MOVIES, "users": USERS, "ratings": RATINGS, "watch_history": WATCH_HISTORY}
