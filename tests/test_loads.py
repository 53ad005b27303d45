"""Loads in input order and malformed lines."""

from __future__ import annotations

from marquee.sources import loaders

COLS = ["movie_title_id", "title"]


def _files(tmp_path, texts):
    for k, text in enumerate(texts):
        (tmp_path / f"part-{k}.csv").write_text(text)
    return str(tmp_path)


def test_first_row_in_the_input_wins(spark, tmp_path):
    path = _files(tmp_path, ["movie_title_id,title\na,Zebra\nb,Middle\na,Aardvark\n", "movie_title_id,title\nb,Alpha\nc,Only\nc,Aaa\n"])
    movies = spark.createDataFrame([(7, "x")], "movie_id long, movie_title_id string")
    new, outcome = loaders.load_movies_csv(loaders.read_csv_lines(spark, path, COLS), movies)
    assert {r.movie_title_id: r.title for r in new.collect()} == {"a": "Zebra", "b": "Middle", "c": "Only"}
    assert "input_position" not in new.columns
    assert tuple(outcome.first()) == (3, 3, 0, 0)


def test_order_holds_across_splits_of_one_file(spark, tmp_path):
    n = 4000
    path = _files(tmp_path, ["movie_title_id,title\n" + "".join(f"k{i % 50},{n - i:06d}\n" for i in range(n))])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = loaders.read_csv_lines(spark, path, COLS)
        assert lines.rdd.getNumPartitions() > 1 and lines.select("input_position.block").distinct().count() > 1
        movies = spark.createDataFrame([], "movie_id long, movie_title_id string")
        new, _ = loaders.load_movies_csv(lines, movies)
        assert {r.movie_title_id: r.title for r in new.collect()} == {f"k{i}": f"{n - i:06d}" for i in range(50)}
        assert [r.title for r in lines.orderBy("input_position").collect()] == [f"{n - i:06d}" for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_malformed_lines_are_rejected_alone(spark, tmp_path):
    path = _files(tmp_path, ['movie_title_id,title\na\na,T,x\n"a,T\na,Good\nb,"un, quoted"\n'])
    lines = loaders.read_csv_lines(spark, path, COLS)
    assert sorted(r.malformed_line for r in lines.where("malformed_line is not null").collect()) == ['"a,T', "a", "a,T,x"]
    movies = spark.createDataFrame([(7, "b")], "movie_id long, movie_title_id string")
    new, outcome = loaders.load_movies_csv(lines, movies)
    assert [(r.movie_id, r.title) for r in new.collect()] == [(8, "Good")]
    assert tuple(outcome.first()) == (1, 0, 1, 3)


def test_malformed_fact_lines_have_a_reason(spark, tmp_path):
    path = _files(tmp_path, ["timestamp,user_id,movie_title,rating\n2024-01-01T00:00:00,1,m,4\n2024-01-01T00:00:00,1\n"
                             "2024-01-01T00:00:00,1,m,4,9\n2024-01-01T00:00:00,1,m,9\n"])
    rows = loaders.read_csv_lines(spark, path, ["timestamp", "user_id", "movie_title", "rating"])
    checked = loaders.validate_fact_rows(rows, "ratings")
    assert [r.reject_reason for r in checked.orderBy("input_position").collect()] == [None, "malformed_line", "malformed_line", "rating_out_of_range"]
    # the reason does not depend on the columns a query reads
    assert checked.where("reject_reason = 'malformed_line'").count() == 2


def test_empty_input(spark, tmp_path):
    path = _files(tmp_path, ["movie_title_id,title\n"])
    movies = spark.createDataFrame([], "movie_id long, movie_title_id string")
    new, outcome = loaders.load_movies_csv(loaders.read_csv_lines(spark, path, COLS), movies)
    assert new.count() == 0
