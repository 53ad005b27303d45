"""Factor updates and the fold over slices against a plain computation; ALS with ids beyond 32 bits."""
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import collaborative as cf

K, DECAY, LR = 4, 1 - 0.1 * 0.01, 0.1


def rows(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 9)) if i % 3 else 5, int(rng.integers(0, 12)) + 100, None if i % 11 == 0 else int(rng.integers(1, 6)), i)
            for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "user_id long, movie_id long, rating int, at long")


def start(spark, ids, key):
    return {getattr(r, key): np.array(r.vec) for r in cf.init_vectors(spark.createDataFrame([(i,) for i in ids], f"{key} long"), key, K).collect()}


def step(spark, batch, users, items):
    """The update written out cell by cell."""
    batch = [r for r in batch if r[2] is not None]
    items = {**start(spark, {r[1] for r in batch} - set(items), "movie_id"), **items} if {r[1] for r in batch} - set(items) else dict(items)
    users, cells = dict(users), defaultdict(float)
    n_item, n_user = defaultdict(int), defaultdict(int)
    for u, m, r, _ in batch:
        cells[u, m] += r
        n_item[m] += 1
        n_user[u] += 1
    sums = defaultdict(lambda: np.zeros(K))
    for (u, m), r in cells.items():
        sums[u] += n_item[m] * r * items[m]
    for u, s in sums.items():
        users[u] = DECAY * users[u] + LR * s if u in users else s
    sums = defaultdict(lambda: np.zeros(K))
    for (u, m), r in cells.items():
        sums[m] += n_user[u] * r * users[u]
    for m, s in sums.items():
        items[m] = DECAY * items[m] + LR * s
    return users, items


def as_dict(long_f, key):
    out = defaultdict(lambda: np.full(K, np.nan))
    for r in long_f.collect():
        out[r[key]][r.dim] = r.value
    return dict(out)


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-9, equal_nan=True), k


def test_update_equals_plain_computation(spark):
    batch = rows(60)
    users, items = start(spark, [1, 2, 5, 77], "user_id"), start(spark, range(100, 108), "movie_id")
    long_of = lambda d, key: spark.createDataFrame(
        [(i, k, float(x)) for i, v in d.items() for k, x in enumerate(v)], f"{key} long, dim int, value double")
    got = cf.factor_update(frame(spark, batch), long_of(users, "user_id"), long_of(items, "movie_id"), k=K)
    want = step(spark, batch, users, items)
    same(as_dict(got[0], "user_id"), want[0])
    same(as_dict(got[1], "movie_id"), want[1])


@pytest.mark.parametrize("compact_every", [2, 50])
def test_fold_over_slices_equals_plain_computation(spark, compact_every):
    data = rows(70, seed=4)
    got = cf.cf_train_incremental(frame(spark, data), ["at"], batch_rows=15, k=K, compact_every=compact_every)
    rated = [r for r in data if r[2] is not None]
    users, items = start(spark, {r[0] for r in rated[:15]}, "user_id"), start(spark, {r[1] for r in rated[:15]}, "movie_id")
    for at in range(0, len(rated), 15):
        users, items = step(spark, rated[at:at + 15], users, items)
    same(as_dict(got[0], "user_id"), users)
    same(as_dict(got[1], "movie_id"), items)


def test_fold_of_an_empty_table(spark):
    users, items = cf.cf_train_incremental(frame(spark, []), ["at"], k=K)
    assert users.count() == 0 and items.count() == 0


def test_vectors_round_trip(spark):
    data = [(1, 0, 0.5), (1, 3, -2.0), (2, 1, 1.0)]
    df = spark.createDataFrame(data, "user_id long, dim int, value double")
    assert sorted(tuple(r) for r in cf.to_long(cf.to_vectors(df, "user_id", K), "user_id").collect()) == data


def test_init_vectors_are_the_long_form(spark):
    ids = spark.range(5).select(F.col("id").alias("user_id"))
    long_f = {(r.user_id, r.dim): r.value for r in cf.factor_init(ids, "user_id", K).collect()}
    assert {(r.user_id, d): v for r in cf.init_vectors(ids, "user_id", K).collect() for d, v in enumerate(r.vec)} == long_f


def test_als_takes_ids_beyond_32_bits(spark):
    big = 2 ** 40
    data = [(u + big, m + 2 * big, r, at) for u, m, r, at in rows(80)]
    users, movies = cf.model_factors_long(*cf.cf_train_als(frame(spark, data), rank=3, max_iter=2))
    assert {r.user_id for r in users.select("user_id").distinct().collect()} == {d[0] for d in data if d[2] is not None}
    assert {r.movie_id for r in movies.select("movie_id").distinct().collect()} == {d[1] for d in data if d[2] is not None}


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_slice_costs_few_jobs(spark):
    fold = lambda n: lambda: cf.cf_train_incremental(frame(spark, [(i % 7, i % 5, 3, i) for i in range(n)]), ["at"], batch_rows=15, k=K)
    per_slice = (jobs_of(spark, "fold-75", fold(75)) - jobs_of(spark, "fold-15", fold(15))) / 4
    assert per_slice <= 15


def test_slices_with_null_ids(spark):
    data = [(None if i % 4 == 0 else i % 5, None if i % 6 == 0 else i % 3, 1 + i % 5, i) for i in range(40)]
    users, items = cf.cf_train_incremental(frame(spark, data), ["at"], batch_rows=10, k=K)
    assert {r.user_id for r in users.collect()} == set(range(5)) and {r.movie_id for r in items.collect()} == {0, 1, 2}


def test_als_drops_the_shuffle_files_of_each_iteration(spark, monkeypatch):
    from pyspark.ml.recommendation import ALS

    seen, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, data: seen.append(self.getCheckpointInterval()) or fit(self, data))
    model, users, movies = cf.cf_train_als(frame(spark, [(1, 2, 3, 0), (1, 3, 5, 1), (2, 2, 1, 2)]), rank=2, max_iter=2)
    assert seen == [1] and users.count() == 2 and model.userFactors.count() == 2


def test_only_small_inputs_are_dealt_to_all_cores(spark):
    from marquee.fixtures import dealt

    cores = spark.sparkContext.defaultParallelism
    large, small = spark.range(0, 100, 1, cores + 3), spark.range(0, 100, 1, 1)
    assert dealt(large, large).rdd.getNumPartitions() == cores + 3
    assert dealt(small, small).rdd.getNumPartitions() == (cores if cores > 1 else 1)
