"""Model artefacts and run records (S-13, S-14, K-12, K-13)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("run_at", T.TimestampNTZType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.LongType())),
    T.StructField("artifact_uri", T.StringType()),
])

EXPECTED = {
    "popular": T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("movie_id", T.LongType()),
                             T.StructField("popularity_score", T.DoubleType())]),
    "profiles": T.StructType([T.StructField("user_id", T.LongType()), T.StructField("genre", T.StringType()),
                              T.StructField("weight", T.DoubleType())]),
    "vectors": T.StructType([T.StructField("movie_id", T.LongType()), T.StructField("genre", T.StringType()),
                             T.StructField("weight", T.FloatType())]),
}


def save_artifact(df: DataFrame, path: str) -> str:
    """K-12: overwrite a versioned artefact folder (Parquet)."""
    df.write.mode("overwrite").parquet(path)
    return path


def load_artifact(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """S-13: read an artefact and check its shape against the expected schema."""
    df = spark.read.parquet(path)
    if kind is not None:
        want = [(f.name, f.dataType) for f in EXPECTED[kind].fields]
        got = [(f.name, f.dataType) for f in df.schema.fields]
        if want != got:
            raise ValueError(f"artefact {path} has schema {got}, expected {want}")
    return df


def run_record(spark: SparkSession, model: str, params: dict, metrics: DataFrame, artifact_uri: str,
               run_at: _dt.datetime | None = None) -> DataFrame:
    """K-13: one row describing a training run; ``metrics`` is a one-row frame
    of counts computed by Spark, folded into a map column."""
    cols = metrics.columns
    m = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("bigint"))])
    p = F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(str(v)))])
    ts = run_at or _dt.datetime(2025, 3, 1)
    return metrics.select(F.lit(model).alias("model"), F.lit(ts).cast("timestamp_ntz").alias("run_at"),
                          p.alias("params"), m.alias("metrics"), F.lit(artifact_uri).alias("artifact_uri"))


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_artifacts(runs: DataFrame) -> DataFrame:
    """S-14: newest artefact URI per model (missing models simply absent)."""
    w = F.max_by("artifact_uri", "run_at")
    return runs.groupBy("model").agg(w.alias("artifact_uri"), F.max("run_at").alias("run_at"))


def save_als(model, path: str) -> str:
    """K-12 for the MLlib model: ``ALSModel.write().overwrite().save``."""
    model.write().overwrite().save(path)
    return path


def load_als(path: str):
    """S-13 for the MLlib model: ``ALSModel.load`` with a rank check on the factors."""
    from pyspark.ml.recommendation import ALSModel

    model = ALSModel.load(path)
    if model.rank <= 0 or "features" not in model.userFactors.columns:
        raise ValueError(f"{path} is not a usable ALS model")
    return model
