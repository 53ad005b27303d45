"""Stream ingest equals the batch parse of the same lines (ST-01 vs P-01/P-02)."""
import pytest
from pyspark.sql import functions as F

from marquee.functions import parsing
from marquee.operators import dimensions
from marquee.session import scratch_path
from marquee.streaming import ingest

LINES = ["2025-01-01T10:00:00,7,GET /data/m/heat+1995/12.mpg",
         "2025-01-01T10:01:00,8,GET /rate/heat+1995=4",
         "2025-01-01T10:02:00,9,GET /data/m/alien+1979/90.mpg",
         "2025-01-01T10:03:00,9,recommendation request h:1, status 200, result: a, 20 ms",
         "bad,9,GET /data/m/a/1.mpg",
         "2025-01-01T10:04:00,10,GET /rate/alien+1979=5"]


def test_stream_equals_batch(spark):
    src = scratch_path(spark, "t-src")
    for i, chunk in enumerate([LINES[:3], LINES[3:]]):
        spark.createDataFrame([(x,) for x in chunk], "value string").coalesce(1).write.text(f"{src}/f{i}")
    out = scratch_path(spark, "t-out")
    q = ingest.start_ingest(ingest.file_source(spark, f"{src}/*", 1), out, scratch_path(spark, "t-ck"))
    q.awaitTermination()
    got = ingest.read_ingested(spark, out)
    dim = got["movies"]
    w = got["watch_history"].join(dim, "movie_id").select("user_id", "movie_title_id", "watched_minutes").collect()
    r = got["ratings"].join(dim, "movie_id").select("user_id", "movie_title_id", "rating").collect()
    batch = spark.createDataFrame([(x,) for x in LINES], "line string")
    bw = parsing.parse_watch(batch).collect()
    br = parsing.parse_rate(batch).collect()
    assert sorted((x.user_id, x.movie_title_id, x.watched_minutes) for x in w) == \
        sorted((int(x.user_id), x.movie_title_id, x.watched_minutes) for x in bw)
    assert sorted((x.user_id, x.movie_title_id, x.rating) for x in r) == \
        sorted((int(x.user_id), x.movie_title_id, x.rating) for x in br)
    # one surrogate id per title across batches
    assert dim.groupBy("movie_title_id").count().where("count > 1").count() == 0
    counts = got["batch_counts"].agg(F.sum("n_watch"), F.sum("n_rate")).first()
    assert tuple(counts) == (2, 2)


def test_store_batch_replay_is_idempotent(spark):
    out = scratch_path(spark, "t-replay")
    batch = spark.createDataFrame([(x,) for x in LINES], "line string")
    first = ingest.store_batch(batch, 0, out)
    again = ingest.store_batch(batch, 0, out)
    assert first == again
    assert spark.read.parquet(f"{out}/watch_history").count() == first["watch_history"]
    ids = spark.read.parquet(f"{out}/movies").select("movie_title_id").distinct().count()
    assert ids == spark.read.parquet(f"{out}/movies").count()


def _batch(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "line string")


def test_batch_of_one_kind_and_users_on_first_sight(spark):
    out = scratch_path(spark, "t-one-kind")
    first = ingest.store_batch(_batch(spark, [LINES[1]]), 0, out)
    assert (first["ratings"], first["watch_history"], first["users"]) == (1, 0, 1)
    second = ingest.store_batch(_batch(spark, [LINES[0], LINES[1]]), 1, out)
    assert (second["ratings"], second["watch_history"], second["users"]) == (1, 1, 1)
    got = ingest.read_ingested(spark, out)
    assert sorted(r.user_id for r in got["users"].collect()) == [7, 8]
    assert got["movies"].count() == 1


def test_a_batch_is_parsed_once_per_kind_and_meets_its_own_keys(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    real = parsing.parse_watch
    monkeypatch.setattr(parsing, "parse_watch", lambda lines: real(lines.mapInArrow(counted, lines.schema)))
    seeds = spark.createDataFrame([(i, "heat+1995" if i == 5 else f"m+{i}") for i in range(50)], "movie_id long, movie_title_id string")
    out = scratch_path(spark, "t-once")
    counts = ingest.store_batch(_batch(spark, LINES), 0, out, seeds)
    assert (counts["watch_history"], counts["ratings"], counts["users"], counts["rejected"]) == (2, 2, 4, 0)
    assert seen.value == len(LINES)
    got = ingest.read_ingested(spark, out)
    assert [tuple(r) for r in got["movies"].select("movie_id", "movie_title_id").collect()] == [(50, "alien+1979")]
    assert sorted(r.movie_id for r in got["watch_history"].collect()) == [5, 50]
    titles = spark.createDataFrame([("heat+1995",), ("b",), ("a",), ("b",), (None,)], "movie_title_id string")
    keys, new = dimensions.batch_movie_keys(titles, seeds)
    assert sorted(tuple(r) for r in keys.collect()) == [(5, "heat+1995"), (50, "a"), (51, "b")]
    assert sorted(tuple(r) for r in new.collect()) == [(50, "a"), (51, "b")]


def test_bad_user_and_rating_are_rejected_alone(spark):
    out = scratch_path(spark, "t-reject")
    lines = ["2025-01-01T10:01:00,abc,GET /rate/heat+1995=4", "2025-01-01T10:01:00,8,GET /rate/heat+1995=4"]
    counts = ingest.store_batch(_batch(spark, lines), 0, out)
    assert (counts["ratings"], counts["rejected"]) == (1, 1)
    assert ingest.read_ingested(spark, out)["batch_counts"].first().n_rejected == 1


def test_damaged_dimension_is_an_error(spark, tmp_path):
    out = str(tmp_path / "sink")
    ingest.store_batch(_batch(spark, [LINES[1]]), 0, out)
    for f in (tmp_path / "sink" / "movies" / "batch_id=0").glob("part-*"):
        f.write_bytes(b"damaged")
    for f in (tmp_path / "sink" / "movies" / "batch_id=0").glob(".part-*.crc"):
        f.unlink()
    with pytest.raises(Exception):
        ingest.store_batch(_batch(spark, [LINES[2]]), 1, out)


def _requests(*tails):
    return [f"2025-01-01T10:0{i}:00,{i},recommendation request h:1, {t}" for i, t in enumerate(tails)]


def test_histograms_survive_a_lost_commit(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    parts = [_requests("status 200, result: a, b, c, 20 ms", "status 500, result: , 700 ms"),
             _requests("status 200, result: a, 5 ms", "status 200, result: a, no time") + [LINES[0]]]

    def run():
        ingest.start_request_histograms(ingest.file_source(spark, f"{src}/*", 1), out, check).awaitTermination()
        return {(r.histogram, r.le): r["count"] for r in ingest.read_request_histograms(spark, out).collect()}

    for i, part in enumerate(parts):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.text(f"{src}/f{i}")
        got = run()
    assert (got["items_returned", "1"], got["items_returned", "5"], got["items_returned", "+Inf"]) == (3, 4, 4)
    assert (got["latency_ms", "5"], got["latency_ms", "25"], got["latency_ms", "750"], got["latency_ms", "+Inf"]) == (1, 2, 3, 3)
    last = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):                   # killed after the write, before the commit
        (tmp_path / "check" / "commits" / name).unlink()
    assert run() == got
    assert run() == got


def test_counters_keep_values_a_later_trigger_does_not_change(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for i, part in enumerate([_requests("status 500, result: , 7 ms"), _requests("status 200, result: a, 7 ms")]):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.text(f"{src}/f{i}")
        ingest.start_request_counters(ingest.file_source(spark, f"{src}/*", 1), out, check).awaitTermination()
    got = {(r.counter, r.label): r.value for r in ingest.read_request_counters(spark, out).collect()}
    assert got == {("requests_total", "all"): 2, ("requests_by_segment", "new"): 2, ("errors_by_type", "exception"): 1}
