"""Log parsers against the hand-written edge rows (FIXTURES §3)."""
import datetime as dt

from marquee.functions import parsing


def lines(spark, *ls):
    return spark.createDataFrame([(x,) for x in ls], "line string")


def test_parse_watch_valid(spark):
    out = parsing.parse_watch(lines(spark, "2025-01-01T10:00:00,7,GET /data/m/heat+1995/12.mpg")).collect()
    assert len(out) == 1
    r = out[0]
    assert r.updated_at == dt.datetime(2025, 1, 1, 10, 0, 0)
    assert (r.user_id, r.movie_title_id, r.watched_minutes) == ("7", "heat+1995", 12)


def test_parse_watch_drops_bad_rows(spark):
    bad = ["2025-01-01T10:00:00,7,GET /data/m/heat+1995/x.mpg",
           "2025-01-01T10:00:00,7,GET /data/m",
           "bad-time,7,GET /data/m/a/1.mpg",
           "2025-01-01T10:00:00,7,GET /data/m/heat, the/12.mpg",      # comma in title
           "2025-01-01T10:00:00Z,7,GET /data/m/a/1.mpg",              # Z suffix rejected
           "2025-01-01 10:00:00.12,7,GET /data/m/a/1.mpg"]            # 2 fraction digits rejected
    assert parsing.parse_watch(lines(spark, *bad)).count() == 0


def test_parse_watch_time_shapes(spark):
    ok = ["2025-01-01,1,GET /data/m/a/1.mpg", "2025-01-01 10,1,GET /data/m/a/1.mpg",
          "2025-01-01T10:00:00.123,1,GET /data/m/a/1.mpg", "2025-01-01T10:00:00.123456,1,GET /data/m/a/1.mpg"]
    got = sorted(r.updated_at for r in parsing.parse_watch(lines(spark, *ok)).collect())
    assert got[0] == dt.datetime(2025, 1, 1)
    assert dt.datetime(2025, 1, 1, 10, 0, 0, 123456) in got and len(got) == 4


def test_parse_rate(spark):
    df = lines(spark, "2025-01-01T10:00:00,7,GET /rate/heat+1995=4",
               "2025-01-01T10:00:00,7,GET /rate/heat+1995=4.5",
               "2025-01-01T10:00:00,7,GET /rate/heat+1995",
               "2025-01-01T10:00:00,7,GET /rate/a=4=5")
    got = sorted((r.movie_title_id, r.rating) for r in parsing.parse_rate(df).collect())
    assert got == [("a", 4), ("heat+1995", 4)]


def test_batch_rate_parser_needs_exactly_two_parts(spark):
    rows = spark.createDataFrame([("t", "7", "GET /rate/a=4=5"), ("t", "7", "GET /rate/heat+1995=4")],
                                 "timestamp string, request_id string, request string")
    got = [(r.movie_title, r.rating) for r in parsing.parse_rate_csv(rows).collect()]
    assert got == [("heat 1995", "4")]


def test_batch_watch_parser_keeps_text_minutes(spark):
    rows = spark.createDataFrame([("t", "7", "GET /data/m/heat+1995/12.mpg")],
                                 "timestamp string, request_id string, request string")
    r = parsing.parse_watch_csv(rows).first()
    assert (r.movie_title, r.watched_minutes) == ("heat 1995", "12")


def test_route_and_request_parse(spark):
    line = "2025-01-01T10:00:00,7,recommendation request h:8082, status 200, result: a, b, 55 ms"
    df = lines(spark, line, "2025-01-01T10:00:00,7,GET /data/m/a/1.mpg")
    kinds = sorted(r.k for r in df.select(parsing.message_kind("line").alias("k")).collect())
    assert kinds == ["request", "watch"]
    r = parsing.parse_request(df).first()
    assert (r.server, r.status, r.result, r.response_ms) == ("h:8082", 200, "a, b", 55)
    assert parsing.parse_watch(lines(spark, line)).count() == 0
