"""CSV loads into the domain tables with row-level rejects (S-05 … S-07, K-03, D-07)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import cleaning, parsing
from ..operators import dimensions

FACT_VALUE = {"ratings": "rating", "watch_history": "watched_minutes"}
CSV_OPTIONS = {"header": "true", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}

# Columns that ``read_csv_lines`` adds to those of the file.
POSITION, MALFORMED = "input_position", "malformed_line"


@dataclass
class FactLoad:
    accepted: DataFrame     # resolved facts ready to append
    rejected: DataFrame     # input rows with ``reject_reason``
    new_movies: DataFrame   # movies created for unseen titles
    new_users: DataFrame    # users created on first sight


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """All-text CSV read with an explicit schema (no inference pass)."""
    reader = spark.read.schema(schemas.all_string(columns))
    for k, v in CSV_OPTIONS.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def read_csv_lines(spark: SparkSession, path: str, columns, header: bool = True) -> DataFrame:
    """:func:`read_csv` with two more columns per line.

    ``input_position`` (file, start of the split in it, number that grows along the split)
    orders rows as the files hold them, files by their path: a split is read by one
    task from its start to its end, so no pass over the input is needed to number lines.
    ``malformed_line`` is the whole line where it has too few or too many fields (an
    unclosed quote swallows the fields behind it), else null.  A line that has its
    fields but leaves the quote of the last one open counts as well formed.
    """
    reader = spark.read.schema(schemas.all_string([*columns, MALFORMED]))
    # with pruned columns the parser no longer counts a line's fields
    for k, v in (CSV_OPTIONS | {"header": str(header).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED,
                                "columnPruning": "false"}).items():
        reader = reader.option(k, v)
    return reader.csv(path).select(*columns, MALFORMED, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")).alias(POSITION))


def write_csv(df: DataFrame, path: str) -> str:
    w = df.write.mode("overwrite")
    for k, v in CSV_OPTIONS.items():
        w = w.option(k, v)
    w.csv(path)
    return path


def validate_fact_rows(rows: DataFrame, table: str) -> DataFrame:
    """P-13 / P-14 on a (timestamp, user_id, movie_title, <value>) text frame; lines of
    :func:`read_csv_lines` with a wrong number of fields are rejected as such."""
    value = FACT_VALUE[table]
    reason = cleaning.reject_reason("user_id", "movie_title", value, value)
    if MALFORMED in rows.columns:
        reason = F.coalesce(F.when(F.col(MALFORMED).isNotNull(), F.lit("malformed_line")), reason)
    if table == "ratings":
        rating = parsing.safe_int(F.col(value))
        reason = F.coalesce(reason, F.when(~cleaning.rating_in_range(rating), F.lit("rating_out_of_range")))
    return rows.withColumn("reject_reason", reason)


def load_fact_csv(rows: DataFrame, table: str, movies: DataFrame, users: DataFrame, as_of: str) -> FactLoad:
    """S-06 / S-07 body: validate, resolve title → id (creating movies), default
    the time, create missing users.  One bad row is rejected alone (D-07)."""
    value = FACT_VALUE[table]
    checked = validate_fact_rows(rows, table)
    ok = checked.where(F.col("reject_reason").isNull())
    typed = ok.select(
        parsing.safe_int(F.col("user_id")).cast("bigint").alias("user_id"),
        parsing.encode_title(F.col("movie_title")).alias("movie_title_id"),
        parsing.safe_int(F.col(value)).alias(value),
        cleaning.time_or_default(F.col("timestamp"), as_of).alias("updated_at"),
    )
    resolved, new_movies = dimensions.resolve_movie_ids(typed, movies)
    return FactLoad(
        accepted=resolved.select("user_id", "movie_id", value, "updated_at"),
        rejected=checked.where(F.col("reject_reason").isNotNull()),
        new_movies=new_movies,
        new_users=dimensions.upsert_users(resolved, users),
    )


def load_movies_csv(csv_df: DataFrame, movies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-05: header mapping + cleaning, then insert-if-absent on ``movie_title_id``.

    Of rows with one title the first in the input is inserted when ``csv_df`` comes from
    :func:`read_csv_lines`, and its malformed lines are rejected; without an input
    position the smallest row by all columns is inserted.

    Returns ``(new movie rows with fresh ids, outcome counts)``.
    """
    mapped = cleaning.map_movie_columns(csv_df, keep=[c for c in (POSITION, MALFORMED) if c in csv_df.columns])
    if MALFORMED in csv_df.columns:
        mapped = mapped.withColumn("movie_title_id", F.when(F.col(MALFORMED).isNull(), F.col("movie_title_id"))).drop(MALFORMED)
    fresh = dimensions.insert_if_absent(mapped, movies, "movie_title_id",
                                        order_col=POSITION if POSITION in csv_df.columns else None).drop(POSITION)
    keyed = dimensions.new_movie_keys(fresh, movies)
    new_rows = fresh.join(keyed, "movie_title_id")
    outcome = dimensions.load_outcome(mapped, movies, "movie_title_id")
    return new_rows, outcome
