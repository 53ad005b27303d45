"""The fold over slices: a fixed number of jobs, and the same factors however tasks share the dimensions."""
from pyspark.sql import functions as F

from marquee.operators import collaborative as cf
from marquee.operators import fold


def frame(spark, data):
    return spark.createDataFrame(data, "user_id long, movie_id long, rating int, at long")


def learned(spark, data, **given):
    users, items = cf.cf_train_incremental(frame(spark, data), ["at"], **given)
    return {(r.user_id, r.dim): r.value for r in users.collect()}, {(r.movie_id, r.dim): r.value for r in items.collect()}


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_the_slices(spark):
    fold_of = lambda n: lambda: cf.cf_train_incremental(frame(spark, [(i % 7, i % 5, 3, i) for i in range(n)]), ["at"], batch_rows=10, k=4)
    assert jobs_of(spark, "slices-40", fold_of(400)) <= jobs_of(spark, "slices-10", fold_of(100)) + 3


def test_blocks_files_and_mapped_state_change_nothing(spark, monkeypatch):
    data = [(None if i % 13 == 0 else i * 7 % 17, None if i % 11 == 0 else i * 5 % 23, None if i % 9 == 0 else 1 + i % 5, i) for i in range(160)]
    want = learned(spark, data, batch_rows=12, k=5)
    monkeypatch.setattr(fold, "STATE_BYTES", 1)
    monkeypatch.setattr(fold, "MAPPED_BYTES", 0)
    monkeypatch.setattr(fold, "CELL_ROWS", 2)
    monkeypatch.setattr(cf, "PART_ROWS", 40)
    assert learned(spark, data, batch_rows=12, k=5) == want and len(want[0]) == 17 * 5 and len(want[1]) == 23 * 5


def test_first_slice_can_be_left_out(spark):
    data = [(1, 10, 4, 0), (2, 11, 5, 1), (1, 11, 3, 2), (3, 12, 2, 3)]
    users, items = learned(spark, data, batch_rows=2, k=3, skip_first=True)
    start = {r.id: r.vec for r in spark.createDataFrame([(i,) for i in (1, 2, 10, 11, 12)], "id long").select("id", cf.init_vector("id", 3).alias("vec")).collect()}
    for d in range(3):
        moved = (1 - 0.1 * 0.01) * start[1][d] + 0.1 * 3 * start[11][d]
        assert abs(users[1, d] - moved) < 1e-12 and users[2, d] == start[2][d] and abs(users[3, d] - 2 * start[12][d]) < 1e-12
        assert items[10, d] == start[10][d] and abs(items[11, d] - ((1 - 0.1 * 0.01) * start[11][d] + 0.1 * 3 * moved)) < 1e-12


def test_some_initial_values_are_those_of_the_vector(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 77, 2 ** 40, -5, None)], "id long")
    for r in ids.select(cf.init_vector("id", 7).alias("a"), F.slice(cf.init_vector("id", 7), 3, 4).alias("b"), cf.init_values("id", range(2, 6)).alias("c")).collect():
        assert r.c == r.b
