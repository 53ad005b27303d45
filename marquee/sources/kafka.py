"""Kafka sources (S-11, S-12).

The Kafka connector is not bundled with every Spark installation; the
functions build the reader and fail with a clear message when the source is
missing.  Everything downstream takes the resulting DataFrame, so tests and
table-backed replays use the same code.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Micro-batch size of the live consumer and poll size of replay.
LIVE_BATCH_MESSAGES = 100
REPLAY_POLL_MESSAGES = 1000


def live_stream(spark: SparkSession, topic: str, bootstrap: str,
                max_per_trigger: int = LIVE_BATCH_MESSAGES) -> DataFrame:
    """S-11 / ST-02: streaming read from the latest offsets, ``line`` text."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
            .option("subscribe", topic).option("startingOffsets", "latest")
            .option("maxOffsetsPerTrigger", str(max_per_trigger)).load()
            .select(F.col("value").cast("string").alias("line"), "partition", "offset", "timestamp"))


def replay(spark: SparkSession, topic: str, bootstrap: str, partition: int, start_offset: int,
           end_offset: int | None = None) -> DataFrame:
    """S-12: bounded batch read of one partition from ``start_offset`` to the
    end (or ``end_offset``), ordered by offset."""
    starting = json.dumps({topic: {str(partition): start_offset}})
    ending = json.dumps({topic: {str(partition): end_offset if end_offset is not None else -1}})
    df = (spark.read.format("kafka").option("kafka.bootstrap.servers", bootstrap)
          .option("assign", json.dumps({topic: [partition]}))
          .option("startingOffsets", starting).option("endingOffsets", ending).load())
    return df.select("offset", F.col("key").cast("string").alias("key"),
                     F.col("value").cast("string").alias("value")).orderBy("offset")


def replay_table(topic: DataFrame, partition: int, start_offset: int, part_col: str = "part_id",
                 offset_col: str = "msg_offset", value_col: str = "line") -> DataFrame:
    """S-12 over a stored topic table (partition, offset, value): the same
    bounded replay, used when the log was landed as a table."""
    return (topic.where((F.col(part_col) == partition) & (F.col(offset_col) >= start_offset))
            .select(F.col(offset_col).alias("offset"), F.lit(None).cast("string").alias("key"),
                    F.col(value_col).alias("value")))
