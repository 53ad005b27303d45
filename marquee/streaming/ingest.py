"""Structured Streaming ingest of the event log (ST-01 … ST-08, K-04, K-10).

``readStream`` (Kafka in production, files in tests) → ``foreachBatch``:
parse watch and rating lines, resolve title ids against the movie dimension
(creating missing movies), and write every output of batch ``b`` into a
``batch_id=b`` partition with dynamic partition overwrite.  A batch replayed
after a failure therefore rewrites exactly its own partitions: the sink is
idempotent and offsets live in the checkpoint (the reference never committed
offsets, so a restart lost the gap).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import dimensions
from ..operators.metrics import ITEMS_BOUNDS, LATENCY_BOUNDS_MS, error_type
from ..functions.scalar import user_segment
from ..session import materialize, materialize_many, path_exists
from ..sources.catalog import valid_facts


TABLES = {
    "watch_history": "updated_at timestamp_ntz, user_id long, movie_id long, watched_minutes int, batch_id long",
    "ratings": "user_id long, movie_id long, rating int, updated_at timestamp_ntz, batch_id long",
    "movies": "movie_id long, movie_title_id string, batch_id long",
    "users": "user_id long, batch_id long",
    "batch_counts": "batch_id long, n_watch long, n_rate long, n_users long, n_rejected long",
}


def _table(spark: SparkSession, out_dir: str, name: str, before: int | None = None) -> DataFrame:
    """A table of the sink, without what batch ``before`` itself wrote (a replay must not
    see it); empty before its first batch.  Any other read error is raised."""
    path = f"{out_dir}/{name}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], TABLES[name])
    df = spark.read.schema(TABLES[name]).parquet(path)
    return df if before is None else df.where(F.col("batch_id") != before)


def _dim_snapshot(spark: SparkSession, out_dir: str, seed_movies: DataFrame | None, before: int) -> DataFrame:
    cur = _table(spark, out_dir, "movies", before).select("movie_id", "movie_title_id")
    return cur if seed_movies is None else cur.unionByName(seed_movies.select("movie_id", "movie_title_id"))


def _write_batch(df: DataFrame, out_dir: str, name: str, batch_id: int) -> int:
    """Rewrite the batch's own partition; the rows written, counted on the way."""
    counted = Observation()
    df.withColumn("batch_id", F.lit(batch_id)).observe(counted, F.count(F.lit(1)).alias("n")) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out_dir}/{name}")
    return counted.get.get("n", 0)


def store_batch(batch: DataFrame, batch_id: int, out_dir: str, seed_movies: DataFrame | None = None,
                tee_dir: str | None = None) -> dict[str, int]:
    """K-04 body for one micro-batch: rows that pass the checks of
    :func:`marquee.sources.catalog.valid_facts` are stored, movies and users
    are created on first sight (J-05, J-06); returns counts per kind (ST-06),
    parsed lines that failed a check as ``rejected``."""
    spark = batch.sparkSession
    lines = batch.select("line").persist()
    try:
        if tee_dir:                                     # K-10 / ST-04 raw tee, one folder per batch
            lines.select(F.col("line").alias("value")).write.mode("overwrite") \
                .text(f"{tee_dir}/batch_id={batch_id}")
        kinds = {"watch_history": (parsing.parse_watch(lines), "watched_minutes"), "ratings": (parsing.parse_rate(lines), "rating")}
        # each line is parsed once per kind; the steps below read the parsed rows
        parsed = dict(zip(kinds, materialize_many([(df.withColumn("user_id", F.col("user_id").try_cast("bigint")), f"parsed-{k}")
                                                   for k, (df, _) in kinds.items()]), strict=True))
    finally:
        lines.unpersist()
    good = {k: valid_facts(df, kinds[k][1]) for k, df in parsed.items()}
    facts = good["watch_history"].select("user_id", "movie_title_id").unionByName(good["ratings"].select("user_id", "movie_title_id"))
    keys, new = dimensions.batch_movie_keys(facts, _dim_snapshot(spark, out_dir, seed_movies, batch_id))
    users = materialize(dimensions.upsert_users(facts, _table(spark, out_dir, "users", batch_id)), "batch-users")
    counts = {}
    for name, cols in (("watch_history", ["updated_at", "user_id", "movie_id", "watched_minutes"]),
                       ("ratings", ["user_id", "movie_id", "rating", "updated_at"])):
        counts[name] = _write_batch(good[name].join(keys, "movie_title_id").select(*cols), out_dir, name, batch_id)
    n_parsed = sum(df.count() for df in parsed.values())
    counts["rejected"] = n_parsed - counts["watch_history"] - counts["ratings"]
    # dimension rows last: a replay before this point re-derives the same ids
    counts["users"] = _write_batch(users, out_dir, "users", batch_id)
    _write_batch(new, out_dir, "movies", batch_id)
    row = (counts["watch_history"], counts["ratings"], counts["users"], counts["rejected"])
    _write_batch(spark.createDataFrame([row], "n_watch long, n_rate long, n_users long, n_rejected long"), out_dir, "batch_counts", batch_id)
    return counts


def file_source(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Test/landing-zone source: text files, ``maxFilesPerTrigger`` plays the
    role of the consumer's micro-batch size (ST-02)."""
    return (spark.readStream.format("text").option("maxFilesPerTrigger", str(max_files_per_trigger))
            .load(path).withColumnRenamed("value", "line"))


def start_ingest(source: DataFrame, out_dir: str, checkpoint: str, seed_movies: DataFrame | None = None,
                 tee_dir: str | None = None, available_now: bool = True):
    """ST-01: run the ingest query; ``available_now`` drains what exists and
    stops (ST-03), otherwise it runs continuously."""
    def body(df, batch_id):
        store_batch(df, batch_id, out_dir, seed_movies, tee_dir)

    w = source.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def read_ingested(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    return {name: _table(spark, out_dir, name) for name in TABLES}


def request_counter_stream(lines: DataFrame) -> DataFrame:
    """ST-07: running request counters over request log lines, per
    (counter, label) — a streaming aggregation."""
    req = parsing.parse_request(lines).withColumn("user_id", F.col("user_id").try_cast("bigint"))
    seg = req.select(F.lit("requests_by_segment").alias("counter"), user_segment("user_id").alias("label"))
    err = req.where(F.col("status") != 200).select(F.lit("errors_by_type").alias("counter"),
                                                   error_type("status").alias("label"))
    tot = req.select(F.lit("requests_total").alias("counter"), F.lit("all").alias("label"))
    return tot.unionByName(seg).unionByName(err).groupBy("counter", "label").agg(F.count(F.lit(1)).alias("value"))


def request_histogram_stream(lines: DataFrame) -> DataFrame:
    """ST-07: running cumulative bucket counts (histogram, le, count) of items returned and
    latency over request log lines.  One streaming aggregate of conditional sums: a row
    of state, whatever the number of requests.  A failed request returned 0 items; a
    line without a response time is in no latency bucket."""
    items = F.when((F.col("status") == 200) & (F.col("result") != ""), F.size(F.split("result", ","))).otherwise(0)
    req = parsing.parse_request(lines).select(items.alias("n_items"), F.col("response_ms").alias("latency_ms"))
    sums, rows = [], []
    for name, col, bounds in (("items_returned", "n_items", ITEMS_BOUNDS), ("latency_ms", "latency_ms", LATENCY_BOUNDS_MS)):
        for le, total in [*((str(b), F.count_if(F.col(col) <= b)) for b in bounds), ("+Inf", F.count(col))]:
            sums.append(total.alias(f"c{len(sums)}"))
            rows.append(f"'{name}', '{le}', c{len(rows)}")
    return req.agg(*sums).selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (histogram, le, count)")


def _start_versions(values: DataFrame, out_dir: str, checkpoint: str, available_now: bool):
    """Each trigger writes the values it changed into a folder of its own, so a replay
    rewrites just that and a crash leaves the versions before it to readers."""
    def body(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = values.writeStream.outputMode("update").foreachBatch(body).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def start_request_counters(lines: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True):
    """ST-07 sink of the counters; read with :func:`read_request_counters`."""
    return _start_versions(request_counter_stream(lines), out_dir, checkpoint, available_now)


def start_request_histograms(lines: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True):
    """ST-07 sink of the histograms; read with :func:`read_request_histograms`."""
    return _start_versions(request_histogram_stream(lines), out_dir, checkpoint, available_now)


def read_request_counters(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest value per (counter, label)."""
    return spark.read.parquet(out_dir).groupBy("counter", "label").agg(F.max_by("value", "batch_id").alias("value"))


def read_request_histograms(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest count per (histogram, le)."""
    return spark.read.parquet(out_dir).groupBy("histogram", "le").agg(F.max_by("count", "batch_id").alias("count"))


__all__ = ["store_batch", "file_source", "start_ingest", "read_ingested", "request_counter_stream",
           "start_request_counters", "request_histogram_stream", "start_request_histograms",
           "read_request_counters", "read_request_histograms"]
