"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _text_arrays(df: DataFrame, cols) -> DataFrame:
    from pyspark.sql import functions as F
    return df.select([F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.concat_ws(", ", F.col(c))).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def query(name: str, oracle: str | None = None, text_arrays: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``oracle`` is
    DuckDB SQL over the driver's views giving the same rows and columns.

    ``text_arrays`` names array columns that the registered output shows as
    ``', '``-joined text (same on the oracle side), so result comparison does
    not depend on how each engine's client renders lists."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        if text_arrays:
            def wrapped(spark, sf_dir, _fn=fn):
                return _text_arrays(_fn(spark, sf_dir), text_arrays)
            wrapped.__doc__, wrapped.__name__, wrapped.__module__ = fn.__doc__, fn.__name__, fn.__module__
            QUERIES[name] = wrapped
        else:
            QUERIES[name] = fn
        if oracle is not None:
            sql = oracle
            if text_arrays:
                repl = ", ".join(f"array_to_string({c}, ', ') as {c}" for c in text_arrays)
                sql = f"select * replace ({repl}) from ({oracle})"
            ORACLE[name] = sql
        return fn
    return deco
