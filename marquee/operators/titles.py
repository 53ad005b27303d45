"""Title bookkeeping of the metadata enrichment (A-09, J-09, J-10, P-29, K-07 … K-09)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import decode_title
from ..functions.scalar import format_metadata_plot
from ..schemas import all_string
from .dimensions import insert_if_absent

# Columns of an enrichment record, as ``format_metadata`` makes them.
METADATA_COLUMNS = ("movie_id", "movie_title_id", "title", "year", "rating", "genres", "plot")


def unique_titles(rows: DataFrame, col: str = "movie_title") -> DataFrame:
    """A-09 / U-05: distinct titles over all input splits."""
    return rows.select(col).where(F.col(col).isNotNull()).distinct()


def unprocessed_titles(unique: DataFrame, metadata: DataFrame, col: str = "movie_title") -> DataFrame:
    """J-09: titles (rows kept as given, duplicates included) whose decoded
    title id is not in the metadata."""
    done = metadata.select(decode_title("movie_title_id").alias(col)).distinct()
    return unique.join(done, col, "left_anti")


def titles_to_fetch(titles: DataFrame, fetched: DataFrame, col: str = "movie_title") -> DataFrame:
    """J-10: resume — skip titles whose metadata row already exists."""
    return unprocessed_titles(titles, fetched, col)


def format_metadata(found: DataFrame) -> DataFrame:
    """P-29: enrichment record: title id with ``+``, rating ``N/A`` default,
    genres joined by ``, ``, plot text before ``::`` or ``N/A``."""
    return found.select(
        F.col("imdb_id").alias("movie_id"),
        F.replace(F.col("query_title"), F.lit(" "), F.lit("+")).alias("movie_title_id"),
        "title", F.col("year").cast("string").alias("year"),
        F.coalesce(F.col("rating").cast("string"), F.lit("N/A")).alias("rating"),
        F.concat_ws(", ", F.coalesce(F.col("genres"), F.array().cast("array<string>"))).alias("genres"),
        format_metadata_plot("plot").alias("plot"))


def enrich_titles(titles: DataFrame, metadata_source: DataFrame, col: str = "movie_title"):
    """J-10 enrichment step against a supplied metadata table (no network):
    returns (formatted rows for matched titles, unmatched titles)."""
    src = metadata_source.withColumnRenamed("title", "title_src")
    matched = titles.join(src, titles[col] == src["lookup_title"], "inner")
    rows = format_metadata(matched.select(F.col(col).alias("query_title"), "imdb_id",
                                          F.col("title_src").alias("title"), "year", "rating", "genres", "plot"))
    unmatched = titles.join(src.select(F.col("lookup_title").alias(col)), col, "left_anti")
    return rows, unmatched


def write_unique_titles(rows: DataFrame, path: str) -> str:
    """K-07: distinct titles to a headed CSV."""
    unique_titles(rows).write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_unprocessed(unique: DataFrame, metadata: DataFrame, path: str) -> str:
    """K-08: unprocessed title rows with their original columns."""
    unprocessed_titles(unique, metadata).write.mode("overwrite").option("header", "true").csv(path)
    return path


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """Folders under ``path`` whose write ended (Spark's ``_SUCCESS`` marker): one name per
    run of the enrichment, and ``path`` itself after a rewrite."""
    base = path.rstrip("/")
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}{sub}/_SUCCESS")) for sub in ("", "/run-*")]
    return sorted(str(s.getPath().getParent()) for some in found for s in (some or []))


def read_metadata(spark: SparkSession, path: str, columns=METADATA_COLUMNS) -> DataFrame:
    """Rows of the committed runs under ``path`` (all text); what an interrupted run left is not read."""
    schema = all_string(columns)
    runs = committed_runs(spark, path)
    return spark.read.schema(schema).option("header", "true").csv(runs) if runs else spark.createDataFrame([], schema)


def append_metadata(rows: DataFrame, path: str, resume: bool = True, run_id: str | None = None) -> str:
    """K-09: enriched metadata rows appended as one run, or the whole file rewritten.

    Each title is stored once: of equal titles in ``rows`` the smallest row by all columns,
    and none that a committed run already has.  A run writes its own folder, which
    counts from its marker on; repeating an interrupted run (same ``run_id``)
    rewrites that folder, and repeating a committed one adds nothing.
    Rows without a title id are not stored.
    """
    spark = rows.sparkSession
    base = path.rstrip("/")
    text = rows.select([F.col(c).cast("string").alias(c) for c in rows.columns])
    if not resume:
        insert_if_absent(text, text.limit(0), "movie_title_id").select(rows.columns) \
            .write.mode("overwrite").option("header", "true").csv(base)
        return path
    run = f"{base}/run-{run_id or uuid.uuid4().hex}"
    if any(done.endswith(f"/{run.rsplit('/', 1)[1]}") for done in committed_runs(spark, base)):
        return path
    fresh = insert_if_absent(text, read_metadata(spark, base, rows.columns), "movie_title_id")
    fresh.select(rows.columns).write.mode("overwrite").option("header", "true").csv(run)
    return path
