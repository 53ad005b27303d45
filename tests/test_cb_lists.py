"""All positive content scores without a shuffle of scores."""
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marquee.operators import content, scoring


def test_scores_leave_the_scoring_task_as_output(spark, monkeypatch):
    """Above the scoring there is neither a join nor an exchange, with lists of one signature in several
    blocks, a null user, a null movie beside others in its signature and one alone in its own."""
    monkeypatch.setattr(content, "MEMBERS", 3)
    monkeypatch.setattr(scoring, "ITEM_BLOCK_BYTES", 100)
    monkeypatch.setattr(scoring, "LIST_BATCH_IDS", 2)
    genres = {m: ("a", "b")[: 1 + m % 2] for m in range(20)} | {20: ("c",), None: ("a",)}
    users = {1: {"a": 0.25, "c": 0.75}, 2: {"b": 1.0}, None: {"a": 1.0}, 2 ** 60 + 1: {"a": 1.0}, 3: {"z": 1.0}}
    profiles = spark.createDataFrame([(u, g, w) for u, p in users.items() for g, w in p.items()], "user_id long, genre string, weight double")
    vectors = spark.createDataFrame([(m, g, 1 / len(gs)) for m, gs in genres.items() for g in gs], "movie_id long, genre string, weight double")
    got = content.cb_scores(profiles, vectors, decimals=6)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Join" not in above and "Exchange" not in above
    want = [(u, m, sum(p.get(g, 0) / len(gs) for g in gs)) for u, p in users.items() for m, gs in genres.items()]
    assert sorted(map(repr, ((r.user_id, r.movie_id, r.score) for r in got.collect()))) == sorted(map(repr, (w for w in want if w[2] > 0)))


def test_no_users_or_no_movies(spark):
    profiles = spark.createDataFrame([(1, "a", 1.0)], "user_id long, genre string, weight double")
    vectors = spark.createDataFrame([(7, "a", 1.0)], "movie_id long, genre string, weight double")
    assert content.cb_scores(profiles.where(F.lit(False)), vectors).count() == 0
    assert content.cb_scores(profiles, vectors.where(F.lit(False))).count() == 0
    assert content.cb_scores(profiles, vectors).count() == 1


def test_lists_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(scoring, "LIST_BATCH_IDS", 4)
    items = SimpleNamespace(lists=pa.array([[1, None], [2, 3, 4], [5]], pa.list_(pa.int64())), n_lists=np.array([1, 0, 2]), first_list=np.array([0, 1, 1]))
    rows, cols = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 2, 0])
    found = list(scoring._with_lists(pa.array([7, None]), rows, cols, np.arange(5.0), items))
    assert len(found) > 1
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == [
        (7, 0.0, [1, None]), (7, 2.0, [2, 3, 4]), (7, 2.0, [5]), (None, 3.0, [2, 3, 4]), (None, 3.0, [5]), (None, 4.0, [1, None])]


def test_a_repeated_genre_counts_as_in_the_items_as_a_whole(spark, monkeypatch):
    """How a repeated key counts depends on the share of the items that have it, which lists do not change."""
    vectors = spark.createDataFrame([(m, g, 0.5) for m in range(12) for g in ("a", f"g{m}", *(["g3"] if m == 3 else []))], "movie_id long, genre string, weight double")
    profiles = spark.createDataFrame([(u, g, 1.0) for u in range(3) for g in ("a", "g3")], "user_id long, genre string, weight double")
    scores = lambda: sorted(map(tuple, content.cb_scores(profiles, vectors).select("user_id", "movie_id", "score").collect()))
    want = scores()
    monkeypatch.setattr(content, "MEMBERS", 1)
    assert scores() == want and len(want) == 36
