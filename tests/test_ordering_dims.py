import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marquee.operators import dimensions
from marquee.operators.ordering import ordered_index


def test_ordered_index_is_contiguous_and_ordered(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = ordered_index(df, ["k"], "i").orderBy("i").collect()
    assert [r.i for r in got] == list(range(5000))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_insert_if_absent(spark):
    dim = spark.createDataFrame([("a",)], "movie_title_id string")
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "movie_title_id string, pos int")
    got = dimensions.insert_if_absent(batch, dim, "movie_title_id", "pos").collect()
    assert [(r.movie_title_id, r.pos) for r in got] == [("b", 2)]
    out = dimensions.load_outcome(batch, dim, "movie_title_id").first()
    assert (out.inserted, out.duplicate, out.already_present, out.rejected) == (1, 1, 1, 0)


def test_new_movie_keys_follow_max_id(spark):
    movies = spark.createDataFrame([(10, "x")], "movie_id long, movie_title_id string")
    facts = spark.createDataFrame([("b",), ("a",), ("x",), ("a",)], "movie_title_id string")
    got = sorted((r.movie_title_id, r.movie_id) for r in dimensions.new_movie_keys(facts, movies).collect())
    assert got == [("a", 11), ("b", 12)]


def test_create_tables_and_insert_record(spark, tmp_path):
    from marquee.sources import catalog
    made = catalog.create_tables(spark, str(tmp_path / "wh"))
    assert set(made) == {"movies", "users", "ratings", "watch_history"}
    assert spark.table("ratings").columns == ["rating_id", "user_id", "movie_id", "rating", "updated_at"]
    catalog.create_tables(spark, str(tmp_path / "wh"))           # idempotent
    movies = spark.createDataFrame([(1, "a+1")], "movie_id long, movie_title_id string")
    import datetime as dt
    path = str(tmp_path / "facts")
    n = catalog.insert_record(spark, {"user_id": 7, "movie_title_id": "b+2", "rating": 4,
                                      "updated_at": dt.datetime(2025, 1, 1)},
                              "user_id long, movie_title_id string, rating int, updated_at timestamp_ntz",
                              movies, path, "rating")
    assert n == 1 and spark.read.parquet(path).first().movie_id == 2
    bad = catalog.insert_record(spark, {"user_id": None, "movie_title_id": "b+2", "rating": 4,
                                        "updated_at": dt.datetime(2025, 1, 1)},
                                "user_id long, movie_title_id string, rating int, updated_at timestamp_ntz",
                                movies, path, "rating")
    assert bad == 0
    # a second new title gets its own id, and both movies are kept
    rec = {"user_id": 7, "movie_title_id": "c+3", "rating": 5, "updated_at": dt.datetime(2025, 1, 2)}
    schema = "user_id long, movie_title_id string, rating int, updated_at timestamp_ntz"
    assert catalog.insert_record(spark, rec, schema, movies, path, "rating") == 1
    assert sorted(r.movie_id for r in spark.read.parquet(path).collect()) == [2, 3]
    assert sorted((r.movie_id, r.movie_title_id) for r in spark.read.parquet(f"{path}-movies").collect()) == [(2, "b+2"), (3, "c+3")]
    assert catalog.insert_record(spark, rec | {"rating": 9}, schema, movies, path, "rating") == 0
    # the count is that of the call, not of the table
    facts = spark.createDataFrame([tuple(rec.values())], schema)
    assert catalog.append_facts(facts, movies, path, "rating", f"{path}-movies")[0] == 1


def _percentiles_match(spark, values, ps=(0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0)):
    from marquee.operators.ordering import exact_percentiles
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
    assert np.allclose(exact_percentiles(df, "x", list(ps)), np.quantile(values, ps), rtol=1e-12)


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    _percentiles_match(spark, rng.integers(0, 50, 4000).astype(float))     # many ties
    _percentiles_match(spark, rng.normal(size=1000) * 1e9 ** rng.normal(size=1000))
    _percentiles_match(spark, np.full(300, 7.5))
    _percentiles_match(spark, np.array([3.0]))


def test_exact_percentiles_narrow_in_several_rounds(spark, monkeypatch):
    from marquee.operators import ordering
    monkeypatch.setattr(ordering, "ACCURACY", 15)
    monkeypatch.setattr(ordering, "SPREAD", 0.05)
    rng = np.random.default_rng(6)
    _percentiles_match(spark, rng.lognormal(3, 2, 5000))
    _percentiles_match(spark, np.where(rng.random(5000) < 0.6, 1.0, rng.normal(size=5000)))


def test_exact_percentiles_of_a_million_values(spark):
    from marquee.operators.ordering import exact_percentiles
    df = spark.range(0, 1_000_000, numPartitions=7).select((F.col("id") * 7919 % 1_000_000).alias("x"))
    assert np.allclose(exact_percentiles(df, "x", [0.5, 0.95, 0.999]), [499999.5, 949999.05, 998999.001])


def test_exact_percentiles_without_values(spark):
    from marquee.operators.ordering import exact_percentiles
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_percentiles(df, "x", [0.5, 0.9]) == [None, None]
    assert exact_percentiles(df.unionByName(spark.createDataFrame([(2.0,)], "x double")), "x", [0.5]) == [2.0]
