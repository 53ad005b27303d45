"""Training pipeline (M-11): popularity, collaborative and content models,
each validated, saved as artefacts and recorded as a run row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import collaborative as cf
from ..operators import content, quality
from ..operators import popularity as pop
from ..sources import artifacts
from ..operators.hybrid import rating_counts


def _counts(spark, **keyed: DataFrame) -> DataFrame:
    """One-row frame of distinct-key counts (each a scalar aggregate)."""
    vals = {k: df.distinct().count() for k, df in keyed.items()}
    return spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} long" for k in vals))


@dataclass
class TrainResult:
    popular: DataFrame
    profiles: DataFrame
    vectors: DataFrame
    user_factors: DataFrame
    item_factors: DataFrame
    counts: DataFrame
    runs: DataFrame


def train_all(movies: DataFrame, ratings: DataFrame, watch: DataFrame, out_dir: str,
              rating_order: list[str], use_als: bool = False, cf_rank: int = cf.N_COMPONENTS,
              export_tables: dict[str, DataFrame] | None = None) -> TrainResult:
    """Run the three trainings in sequence on the given tables.

    Collaborative training folds the incremental update over time slices by
    default (the reference's method); ``use_als`` switches to MLlib ALS.
    With ``export_tables`` the run ends with the combined table export (K-11).
    """
    spark = movies.sparkSession
    runs = []

    checks = quality.validate_frame(movies, ["movie_id", "rating", "votes"])
    if not checks.where(~F.col("valid")).isEmpty():
        raise ValueError("movie table failed validation")
    popular = pop.popular_movies(movies)
    p_uri = artifacts.save_artifact(popular, f"{out_dir}/popular")
    runs.append(artifacts.run_record(
        spark, "popularity", {"top_n": pop.POPULAR_TOP_N},
        spark.read.parquet(p_uri).agg(F.count(F.lit(1)).alias("num_popular_movies")), p_uri))

    if use_als:
        uf, itf = cf.model_factors_long(*cf.cf_train_als(ratings, rank=cf_rank))
    else:
        uf, itf = cf.cf_train_incremental(ratings, rating_order, k=cf_rank)
    counts = rating_counts(ratings.where(F.col("rating").isNotNull()))
    u_uri = artifacts.save_artifact(uf, f"{out_dir}/user_factors")
    i_uri = artifacts.save_artifact(itf, f"{out_dir}/item_factors")
    c_uri = artifacts.save_artifact(counts, f"{out_dir}/user_rating_count")
    cf_metrics = _counts(spark, num_users=spark.read.parquet(u_uri).select("user_id"),
                         num_items=spark.read.parquet(i_uri).select("movie_id"))
    runs.append(artifacts.run_record(
        spark, "collaborative", {"n_components": cf_rank, "seed": cf.SEED, "batch_size": cf.BATCH_ROWS},
        cf_metrics, u_uri))

    profiles, vectors, _ = content.content_model(watch, movies)
    pr_uri = artifacts.save_artifact(profiles, f"{out_dir}/profiles")
    v_uri = artifacts.save_artifact(vectors.withColumn("weight", F.col("weight").cast("float")),
                                    f"{out_dir}/vectors")
    cb_metrics = _counts(spark, num_users=spark.read.parquet(pr_uri).select("user_id"),
                         num_movies=spark.read.parquet(v_uri).select("movie_id"))
    runs.append(artifacts.run_record(spark, "content", {"top_n": 20}, cb_metrics, v_uri))

    run_df = runs[0]
    for r in runs[1:]:
        run_df = run_df.unionByName(r)
    artifacts.append_run(run_df, f"{out_dir}/model_runs")
    if export_tables:
        from .export import export_all_tables
        export_all_tables(export_tables, f"{out_dir}/export")
    return TrainResult(spark.read.parquet(p_uri), spark.read.parquet(pr_uri), spark.read.parquet(v_uri),
                       spark.read.parquet(u_uri), spark.read.parquet(i_uri), spark.read.parquet(c_uri),
                       spark.read.parquet(f"{out_dir}/model_runs"))
