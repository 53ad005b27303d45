"""Domain table catalogue: creation and appends (K-01, K-02, K-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import dimensions
from ..session import materialize, path_exists

MOVIE_KEYS = "movie_id long, movie_title_id string"


def create_tables(spark: SparkSession, location: str) -> list[str]:
    """K-01: ``CREATE TABLE IF NOT EXISTS … USING parquet`` for the four tables
    under ``location`` (one folder each); existing tables are left alone."""
    made = []
    for name, schema in schemas.TABLE_SCHEMAS.items():
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
                  f"LOCATION '{location.rstrip('/')}/{name}'")
        made.append(name)
    return made


def valid_facts(facts: DataFrame, value_col: str) -> DataFrame:
    """Rows the fact tables accept: user, title and value present, ratings from 1 to 5 (P-14)."""
    ok = F.col("user_id").isNotNull() & F.col("movie_title_id").isNotNull() & F.col(value_col).isNotNull()
    return facts.where(ok & F.col(value_col).between(1, 5) if value_col == "rating" else ok)


def append_facts(facts: DataFrame, movies: DataFrame, table_path: str, value_col: str,
                 movies_path: str | None = None) -> tuple[int, DataFrame]:
    """K-03: resolve ``movie_title_id`` → ``movie_id`` (creating missing movies,
    J-05) and append the valid rows; returns (rows appended, new movie rows).

    With ``movies_path`` the movies created so far are read from there and the
    new ones are appended, so a later call finds them.
    """
    spark = facts.sparkSession
    keys = movies.select("movie_id", "movie_title_id")
    if movies_path and path_exists(spark, movies_path):
        keys = keys.unionByName(spark.read.schema(MOVIE_KEYS).parquet(movies_path))
    ok = valid_facts(facts, value_col)
    new_movies = materialize(dimensions.new_movie_keys(ok, keys), "new-movies")
    resolved = ok.join(keys.unionByName(new_movies), "movie_title_id")
    counted = Observation()
    resolved.select("user_id", "movie_id", value_col, "updated_at").observe(counted, F.count(F.lit(1)).alias("n")) \
        .write.mode("append").parquet(table_path)
    if movies_path:
        new_movies.write.mode("append").parquet(movies_path)
    return counted.get.get("n", 0), new_movies


def insert_record(spark: SparkSession, record: dict, schema: str, movies: DataFrame, table_path: str,
                  value_col: str, movies_path: str | None = None) -> int:
    """K-02: a single record is a one-row frame through the same path as K-03;
    a record that fails validation is rejected alone (returns 0).  Movies it
    creates are kept in ``movies_path`` (beside the table unless given)."""
    row = spark.createDataFrame([record], schema)
    if valid_facts(row, value_col).isEmpty():
        return 0
    return append_facts(row, movies, table_path, value_col, movies_path or f"{table_path.rstrip('/')}-movies")[0]
