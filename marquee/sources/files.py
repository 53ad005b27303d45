"""File scans and writes (S-01 … S-04, S-14, K-05 … K-10, K-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import parsing


def scan_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """S-01: headerless 3-column log CSV; input splits replace pandas chunks.
    Extra comma fields (request lines) are dropped, as a 3-column reader does."""
    return (spark.read.schema(schemas.LOG_CSV)
            .option("header", "false").option("mode", "PERMISSIVE").csv(path))


def scan_csv_header(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S-02: headed CSV, all columns; an explicit schema avoids an inference pass."""
    reader = spark.read.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def scan_csv_pruned(spark: SparkSession, path: str, columns, schema=None) -> DataFrame:
    """S-03: only the needed columns (CSV column pruning is built in)."""
    return scan_csv_header(spark, path, schema).select(*columns)


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw log lines, one per row (``value`` renamed to ``line``)."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def process_log_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S-04: raw log text file → {'data': watch rows, 'rate': rating rows}."""
    lines = read_log_text(spark, path)
    return {"data": parsing.parse_watch(lines), "rate": parsing.parse_rate(lines)}


def write_text_lines(df: DataFrame, path: str, col: str = "line") -> str:
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
    return path


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> str:
    """K-05 / K-07 / K-08 / K-09 building block: headed CSV, partitioned write."""
    df.write.mode(mode).option("header", str(header).lower()).csv(path)
    return path


def save_processed_data(processed: dict[str, DataFrame], output_dir: str) -> dict[str, str]:
    """K-05: write each non-empty frame as ``<kind>_entries`` CSV, return paths."""
    paths = {}
    for kind, df in processed.items():
        if not df.isEmpty():
            paths[kind] = write_csv(df, f"{output_dir.rstrip('/')}/{kind}_entries")
    return paths


def write_json(df: DataFrame, path: str) -> str:
    """K-14: metrics bundle (one row) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """T-06: the first rows of a source."""
    return df.limit(n)
