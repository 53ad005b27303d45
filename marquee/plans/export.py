"""Export of all base tables into one text CSV (K-11, U-02, P-19, P-30)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import fill_null_text


def union_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """U-02 + P-30 + P-19: every column as text, a ``table_name`` column, union
    by name with missing columns NULL, then NULL → ``'null'``; every row."""
    out = None
    for name, df in tables.items():
        t = df.select([F.col(c).cast("string").alias(c) for c in df.columns]).withColumn("table_name", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return fill_null_text(out)


def export_all_tables(tables: dict[str, DataFrame], path: str) -> str:
    """K-11: write the combined export (one headed CSV folder)."""
    union_tables(tables).write.mode("overwrite").option("header", "true").csv(path)
    return path
