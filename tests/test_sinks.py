"""Written outputs read back: titles, metadata runs, metrics JSON, raw tee."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from marquee.operators import titles
from marquee.session import scratch_path
from marquee.sources import files
from marquee.streaming import ingest

COLS = "movie_id string, movie_title_id string, title string, year string, rating string, genres string, plot string"


def _rows(spark, *keys, title="T"):
    return spark.createDataFrame([(f"tt{k}", k, title, "1999", "N/A", "Drama, War", 'a "quoted", plot') for k in keys], COLS)


def _stored(spark, path):
    return sorted(tuple(r) for r in titles.read_metadata(spark, path).select("movie_title_id", "title", "plot").collect())


def test_titles_written_once(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), (None,), ("c, d",)], "movie_title string")
    path = titles.write_unique_titles(rows, scratch_path(spark, "t-unique"))
    back = spark.read.option("header", "true").csv(path)
    assert sorted(r.movie_title for r in back.collect()) == ["a b", "c, d"]
    todo = spark.createDataFrame([("a b", 1), ("x", 2), ("x", 3)], "movie_title string, n int")
    meta = spark.createDataFrame([("a+b",)], "movie_title_id string")
    path = titles.write_unprocessed(todo, meta, scratch_path(spark, "t-todo"))
    back = spark.read.option("header", "true").csv(path)
    assert back.columns == ["movie_title", "n"] and sorted(tuple(r) for r in back.collect()) == [("x", "2"), ("x", "3")]


def test_metadata_runs_add_each_title_once(spark):
    path = scratch_path(spark, "t-meta")
    plot = 'a "quoted", plot'
    assert _stored(spark, path) == []
    titles.append_metadata(_rows(spark, "a", "b", "b", title="old"), path, run_id="1")
    titles.append_metadata(_rows(spark, "b", "c", title="new"), path, run_id="2")
    want = [("a", "old", plot), ("b", "old", plot), ("c", "new", plot)]
    assert _stored(spark, path) == want
    # a repeated run adds nothing, under its own id or another
    titles.append_metadata(_rows(spark, "z"), path, run_id="2")
    titles.append_metadata(_rows(spark, "a", "c", title="again"), path)
    assert _stored(spark, path) == want
    # empty input is a run too
    titles.append_metadata(_rows(spark, "a").limit(0), path, run_id="3")
    assert _stored(spark, path) == want
    titles.append_metadata(_rows(spark, "q", "q", title="only"), path, resume=False)
    assert _stored(spark, path) == [("q", "only", plot)]
    titles.append_metadata(_rows(spark, "q", "r", title="later"), path, run_id="4")
    assert _stored(spark, path) == [("q", "only", plot), ("r", "later", plot)]


def test_interrupted_metadata_run(spark):
    path = scratch_path(spark, "t-meta-cut")
    titles.append_metadata(_rows(spark, "a"), path, run_id="1")
    boom = F.udf(lambda k: 1 // 0 if k == "d" else k)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        titles.append_metadata(_rows(spark, "b", "c", "d").withColumn("movie_title_id", boom("movie_title_id")), path, run_id="2")
    # rows left behind without a marker are not read, and the repeated run replaces them
    _rows(spark, "b").write.mode("overwrite").option("header", "true").csv(f"{path}/run-2")
    os.remove(f"{path}/run-2/_SUCCESS")
    assert [r[0] for r in _stored(spark, path)] == ["a"]
    titles.append_metadata(_rows(spark, "a", "b", "c", "d"), path, run_id="2")
    assert [r[0] for r in _stored(spark, path)] == ["a", "b", "c", "d"]


def test_metrics_json_and_preview(spark):
    one = spark.createDataFrame([(3, 0.25, None)], "n long, hit_rate double, note string")
    path = files.write_json(one, scratch_path(spark, "t-json"))
    assert files.read_json(spark, path, one.schema).collect() == one.collect()
    assert files.preview(spark.range(20)).count() == 5 and files.preview(spark.range(3)).count() == 3


def test_raw_tee_is_rewritten_by_a_replay(spark):
    lines = ["2025-01-01T10:00:00,7,GET /data/m/heat+1995/12.mpg", "not a request", "2025-01-01T10:01:00,8,GET /rate/heat+1995=4"]
    batch = spark.createDataFrame([(x,) for x in lines], "line string")
    out, tee = scratch_path(spark, "t-tee-out"), scratch_path(spark, "t-tee")
    for batch_id in (0, 1, 1):
        ingest.store_batch(batch, batch_id, out, tee_dir=tee)
    got = spark.read.text(tee)
    assert sorted((r.batch_id, r.value) for r in got.collect()) == sorted((b, x) for b in (0, 1) for x in lines)
