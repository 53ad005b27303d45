"""Cleaning and validation expressions (FIXTURES §3)."""
from pyspark.sql import functions as F

from marquee.functions import cleaning, parsing


def one_col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_clean_na(spark):
    assert one_col(spark, ["", "  ", "n/a", "N/A", " N/A ", "ok"], cleaning.clean_na) == \
        [None, None, None, None, " N/A ", "ok"]


def test_safe_numeric(spark):
    assert one_col(spark, ["1995", "1995.5", "abc", " +7 "], parsing.safe_int) == [1995, None, None, 7]
    assert one_col(spark, ["7.5", "x", ".5"], cleaning.safe_float) == [7.5, None, 0.5]


def test_split_list_keeps_empties(spark):
    assert one_col(spark, ["Drama, Sci-Fi ,"], cleaning.split_list) == [["Drama", "Sci-Fi", ""]]


def test_parse_list_literal(spark):
    got = one_col(spark, ["['Canada', 'United Kingdom']", " France ", "[oops", "[oops]",
                          "['x', \"Cote d'Ivoire\"]"], cleaning.parse_list_literal)
    assert got == [["Canada", "United Kingdom"], ["France"], ["[oops"], [], ["x", "Cote d'Ivoire"]]


def test_parse_runtime(spark):
    assert one_col(spark, ["['96']", "96", "['x']", "[]"], cleaning.parse_runtime) == [96, 96, None, None]


def test_validate_rows_reasons(spark):
    df = spark.createDataFrame([(None, "t", "4"), ("abc", "t", "4"), ("7", "", "4"), ("7", "t", "x"),
                                ("7", "t", "4")], "user_id string, movie_title string, rating string")
    got = [r.reject_reason for r in cleaning.validate_rows(df, "rating", title_col="movie_title").collect()]
    assert got[:4] == ["missing_user_id", "invalid_user_id", "missing_title", "invalid_rating"]
    assert got[4] is None


def test_rating_range(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (6,), (None,)], "r int")
    assert [r[0] for r in df.select(cleaning.rating_in_range("r")).collect()] == [False, True, True, False, True]


def test_map_movie_columns_absent_columns_are_null(spark):
    df = spark.createDataFrame([("tt1", "a+1", "A", "1999", "N/A", "Drama, Comedy")],
                               "movie_id string, movie_title_id string, title string, year string, rating string, "
                               "genres string")
    r = cleaning.map_movie_columns(df).first()
    assert (r.imdb_id, r.year, r.rating, r.genres, r.duration, r.actors) == \
        ("tt1", 1999, None, ["Drama", "Comedy"], None, None)
