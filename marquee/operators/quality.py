"""Data and model validation gates (A-23, A-25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_frame(df: DataFrame, required: list[str]) -> DataFrame:
    """A-23: required columns present, row count, NULLs per required column,
    all in one aggregate pass.  Missing columns are reported, not raised."""
    present = [c for c in required if c in df.columns]
    missing = [c for c in required if c not in df.columns]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(f"nulls_{c}") for c in present]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', nulls_{c}" for c in present)
    per_col = (row.selectExpr("n_rows", f"stack({len(present)}, {stack}) as (column_name, null_count)")
               if present else row.select("n_rows", F.lit(None).cast("string").alias("column_name"),
                                          F.lit(None).cast("bigint").alias("null_count")))
    out = per_col.withColumn("present", F.lit(True))
    for c in missing:
        out = out.unionByName(row.select("n_rows", F.lit(c).alias("column_name"),
                                         F.lit(None).cast("bigint").alias("null_count"),
                                         F.lit(False).alias("present")))
    return out.withColumn("valid", F.lit(not missing) & (F.col("n_rows") > 0))


def validate_models(popular: DataFrame, content_lists: DataFrame, probe_users: list[int] | None = None,
                    n: int = 20) -> DataFrame:
    """A-25: the popularity list yields ≥1 of its top n, and the content model
    yields ≥1 recommendation for the profiled users (or only ``probe_users``);
    overall pass = all."""
    pop_n = popular.where(F.col("rank") <= n).agg(F.count(F.lit(1)).alias("n_recs")) \
        .select(F.lit("popularity").alias("model"), "n_recs")
    lists = content_lists if probe_users is None else content_lists.where(F.col("user_id").isin(probe_users))
    cb_n = (lists.where(F.col("rank") <= n)
            .agg(F.count(F.lit(1)).alias("n_recs")).select(F.lit("content_based").alias("model"), "n_recs"))
    both = pop_n.unionByName(cb_n).withColumn("generated", F.col("n_recs") > 0)
    overall = both.agg(F.bool_and("generated").alias("generated"), F.sum("n_recs").alias("n_recs")) \
        .select(F.lit("all_valid").alias("model"), "n_recs", "generated")
    return both.unionByName(overall)


def require_valid(validation: DataFrame) -> None:
    """The CI gate of A-25: raise when the overall row says not all models
    produced recommendations (the reference exited non-zero)."""
    row = validation.where(F.col("model") == "all_valid").select("generated").first()
    if row is None or not row["generated"]:
        raise RuntimeError("model validation failed")
