"""Cleaning, validation and safe conversion expressions (P-07 … P-16, P-19, P-33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parsing import INT_PATTERN, iso_time, safe_int

FLOAT_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_na(c) -> Column:
    """P-07: null, blank after trim, or ``N/A`` in any case (untrimmed) → NULL."""
    x = _c(c)
    return F.when(x.isNull() | (F.trim(x) == "") | (F.upper(x) == "N/A"), F.lit(None)).otherwise(x)


def safe_float(c) -> Column:
    """P-08 float parse; failure → NULL."""
    x = _c(c)
    return F.when(x.rlike(FLOAT_PATTERN), F.trim(x).try_cast("double"))


def split_list(c) -> Column:
    """P-09: comma list → trimmed array, empty elements kept."""
    return F.transform(F.split(_c(c), ",", -1), lambda e: F.trim(e))


def parse_list_literal(c) -> Column:
    """P-10: ``['a', "b"]`` → array; a scalar → one trimmed element; a bracketed
    text that is not a list literal → empty array."""
    x = _c(c)
    bracketed = x.startswith("[") & x.endswith("]")
    parsed = F.from_json(x, T.ArrayType(T.StringType()), {"allowSingleQuotes": "true"})
    return (F.when(x.isNull(), F.lit(None))
            .when(bracketed, F.coalesce(parsed, F.array().cast("array<string>")))
            .otherwise(F.array(F.trim(x))))


def parse_runtime(c) -> Column:
    """P-11: ``['96']`` or ``96`` → 96; first list element only; non-digits → NULL."""
    x = _c(c)
    inner = F.regexp_extract(x, r"^\[\s*['\"]?([^,'\"\]]*)['\"]?\s*(,.*)?\]$", 1)
    return (F.when(x.startswith("[") & x.endswith("]"),
                   F.when(inner.rlike(r"^\d+$"), inner.try_cast("int")))
            .when(x.rlike(r"^\d+$"), x.try_cast("int")))


def time_or_default(c, as_of) -> Column:
    """P-12: ISO parse, missing/invalid → ``as_of`` (a parameter, not now())."""
    return F.coalesce(iso_time(_c(c)), F.lit(as_of).cast("timestamp_ntz"))


def reject_reason(user, title, value, value_name: str) -> Column:
    """P-13: first failing required-field check, NULL when the row is accepted."""
    u, t, v = _c(user), _c(title), _c(value)
    # Presence is Python truthiness (empty text is missing, blanks are not).
    return (F.when(u.isNull() | (u == ""), F.lit("missing_user_id"))
            .when(~u.rlike(INT_PATTERN), F.lit("invalid_user_id"))
            .when(t.isNull() | (t == ""), F.lit("missing_title"))
            .when(v.isNull() | (v.cast("string") == ""), F.lit(f"missing_{value_name}"))
            .when(~v.cast("string").rlike(INT_PATTERN), F.lit(f"invalid_{value_name}")))


def validate_rows(df: DataFrame, value_col: str, user_col="user_id", title_col="movie_title_id") -> DataFrame:
    """P-13: adds ``reject_reason``; accepted rows carry NULL."""
    return df.withColumn("reject_reason",
                         reject_reason(user_col, title_col, value_col, value_col))


def rating_in_range(c) -> Column:
    """P-14 CHECK: 1..5, NULL passes."""
    x = _c(c)
    return x.isNull() | x.between(1, 5)


def fill_null_text(df: DataFrame, token: str = "null") -> DataFrame:
    """P-19: every column as text, NULL → ``'null'``."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit(token)).alias(c) for c in df.columns])


def map_movie_columns(csv_df: DataFrame, keep=()) -> DataFrame:
    """P-33 + P-07…P-11: CSV header → movies columns with cleaning and typing.

    Absent CSV columns become NULL (the reference failed the whole row, D-06);
    the columns named in ``keep`` pass through.
    """
    present = set(csv_df.columns)

    def src(csv_col):
        return clean_na(F.col(f"`{csv_col}`")) if csv_col in present else F.lit(None).cast("string")

    return csv_df.select(
        src("movie_id").alias("imdb_id"),
        src("movie_title_id").alias("movie_title_id"),
        src("title").alias("title"),
        safe_int(src("year")).alias("year"),
        safe_float(src("rating")).alias("rating"),
        split_list(src("genres")).alias("genres"),
        src("plot").alias("plot"),
        parse_runtime(src("runtime")).alias("duration"),
        split_list(src("directors")).alias("directors"),
        split_list(src("cast")).alias("actors"),
        safe_int(src("votes")).alias("votes"),
        parse_list_literal(src("languages")).alias("languages"),
        parse_list_literal(src("country")).alias("country"),
        src("release_date").try_cast("date").alias("release_date"),
        src("poster").alias("poster"),
        *keep,
    )
