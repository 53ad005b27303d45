from marquee.functions import genres


def test_genres_from_array(spark):
    df = spark.createDataFrame([([" Sci-Fi ", "sci fi", None, ""],), (None,)], "g array<string>")
    got = [r[0] for r in df.select(genres.genres_from_array("g")).collect()]
    assert got == [["sci_fi"], []]


def test_genres_from_string(spark):
    df = spark.createDataFrame([("Science Fiction, Drama drama",), (" a",), (None,)], "g string")
    got = [r[0] for r in df.select(genres.genres_from_string("g")).collect()]
    assert got == [["science", "fiction", "drama"], ["a"], []]


def test_watch_weight(spark):
    df = spark.createDataFrame([(40,), (None,), (100,)], "m int")
    got = [r[0] for r in df.select(genres.watch_weight("m")).collect()]
    assert got[0] == 0.5 and got[1] == 0.0
    assert abs(got[2] - genres.watch_weight_py(100)) < 1e-12
