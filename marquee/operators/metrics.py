"""Request-log metrics and topic summaries (A-18 … A-22, P-24, P-32).

The reference measured these from live HTTP calls and in-process counters;
here they are aggregates over a request-log table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import user_segment
from .ordering import exact_percentiles

# SLA threshold (ms) and histogram bucket bounds.
SLA_MS = 300.0
ITEMS_BOUNDS = (1, 5, 10, 20, 30, 50)
# Default latency buckets of the metrics client, in milliseconds.
LATENCY_BOUNDS_MS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
# HTTP status → error type label of the serving layer's error counter.
ERROR_TYPES = {400: "bad_request", 429: "rate_limited", 500: "exception", 503: "service_unavailable"}


def latency_summary(requests: DataFrame, col: str = "latency_ms") -> DataFrame:
    """A-18: mean, p50, p95, p99, max, population stddev, 2 dp.

    Percentiles are exact (linear interpolation) and distributed: a global
    index over the sorted values, then the few rows at the needed positions.
    Moments are one partial aggregate.
    """
    x = F.col(col).cast("double")
    p50, p95, p99 = exact_percentiles(requests, col, [0.5, 0.95, 0.99])
    agg = requests.agg(F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"))

    def lit(v):
        return F.lit(v).cast("double")

    return agg.select(F.round("mean", 2).alias("mean_ms"), F.round(lit(p50), 2).alias("median_ms"),
                      F.round(lit(p95), 2).alias("p95_ms"), F.round(lit(p99), 2).alias("p99_ms"),
                      F.round("max", 2).alias("max_ms"), F.round("std", 2).alias("stddev_ms"))


def request_quality(requests: DataFrame, sla_ms: float = SLA_MS) -> DataFrame:
    """A-19: success / error rate, throughput = n / Σ latency (s), SLA
    violation rate, mean items (failures count as 0 items)."""
    ok = F.col("status") == 200
    lat = F.col("latency_ms").cast("double")
    agg = requests.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("n_ok"),
        F.sum(lat).alias("total_ms"),
        F.sum(F.when(lat > sla_ms, 1).otherwise(0)).alias("n_slow"),
        F.avg(F.when(ok, F.col("n_items")).otherwise(0)).alias("mean_items"))
    return agg.select(
        F.col("n").alias("n_requests"),
        F.round(F.col("n_ok") / F.col("n"), 4).alias("success_rate"),
        F.round((F.col("n") - F.col("n_ok")) / F.col("n"), 4).alias("error_rate"),
        F.round(F.col("n") / (F.col("total_ms") / 1000.0), 2).alias("throughput_rps"),
        F.round(F.col("n_slow") / F.col("n"), 4).alias("sla_violation_rate"),
        F.round("mean_items", 2).alias("mean_items"))


def error_type(status) -> F.Column:
    s = F.col(status) if isinstance(status, str) else status
    out = F.lit("exception")
    for code, name in sorted(ERROR_TYPES.items(), reverse=True):
        out = F.when(s == code, F.lit(name)).otherwise(out)
    return F.when(s == 200, F.lit(None)).otherwise(out)


def request_counters(requests: DataFrame) -> DataFrame:
    """A-20: total requests, requests per user segment, errors per type, as
    one (counter, label, value) frame."""
    seg = requests.groupBy(user_segment("user_id").alias("label")).agg(F.count(F.lit(1)).alias("value")) \
        .withColumn("counter", F.lit("requests_by_segment"))
    err = (requests.where(F.col("status") != 200).groupBy(error_type("status").alias("label"))
           .agg(F.count(F.lit(1)).alias("value")).withColumn("counter", F.lit("errors_by_type")))
    tot = requests.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("requests_total").alias("counter"), F.lit("all").alias("label"), "value")
    return tot.unionByName(seg.select("counter", "label", "value")).unionByName(err.select("counter", "label", "value"))


def cumulative_histogram(df: DataFrame, col: str, bounds, name: str) -> DataFrame:
    """A-21: cumulative bucket counts ``le=<bound>`` plus ``+Inf``; one pass,
    one conditional sum per bound (bounds are a fixed short list)."""
    x = F.col(col)
    aggs = [F.sum(F.when(x <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.lit(1)).alias("inf"))
    row = df.agg(*aggs)
    labels = [(str(b), f"b{i}") for i, b in enumerate(bounds)] + [("+Inf", "inf")]
    stack = ", ".join(f"'{lab}', {c}" for lab, c in labels)
    return row.selectExpr(f"stack({len(labels)}, {stack}) as (le, count)").select(
        F.lit(name).alias("histogram"), "le", F.col("count").cast("bigint").alias("count"))


def items_histogram(requests: DataFrame) -> DataFrame:
    return cumulative_histogram(requests, "n_items", ITEMS_BOUNDS, "items_returned")


def latency_histogram(requests: DataFrame) -> DataFrame:
    return cumulative_histogram(requests, "latency_ms", LATENCY_BOUNDS_MS, "latency_ms")


def topic_offsets(topic: DataFrame, part_col: str = "part_id", offset_col: str = "msg_offset") -> DataFrame:
    """A-22: per partition first offset, end offset (last + 1), message count,
    and the topic total as a rollup row (partition NULL)."""
    per = topic.groupBy(part_col).agg(F.min(offset_col).alias("begin_offset"),
                                      (F.max(offset_col) + 1).alias("end_offset"))
    per = per.withColumn("n_messages", F.col("end_offset") - F.col("begin_offset"))
    total = per.agg(F.sum("n_messages").alias("n_messages")).select(
        F.lit(None).cast(dict(per.dtypes)[part_col]).alias(part_col), F.lit(None).cast("bigint").alias("begin_offset"),
        F.lit(None).cast("bigint").alias("end_offset"), F.col("n_messages").cast("bigint").alias("n_messages"))
    return per.unionByName(total)
