"""Blocked top-N scorer against brute force, including the multi-block path."""
import numpy as np
import pytest

from marquee.operators import content, scoring


def _brute(q, items, k, positive_only=False, exclude_self=False):
    out = {}
    for qi, qv in q:
        cand = []
        for ii, iv in items:
            s = float(np.dot(qv, iv))
            if positive_only and s <= 0:
                continue
            if exclude_self and ii == qi:
                continue
            cand.append((-round(s, 6), ii))
        out[qi] = [ii for _, ii in sorted(cand)[:k]]
    return out


def _run(spark, q, items, k, **kw):
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in q], "qid long, vec array<double>")
    idf = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in items],
                                "iid long, tie long, vec array<double>")
    res = scoring.topk_dot(qdf, "qid", idf, "iid", "tie", k, **kw).orderBy("qid", "rank").collect()
    got = {}
    for r in res:
        got.setdefault(r.qid, []).append(r.item_id)
    return got


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    q = [(i, rng.integers(-2, 3, 6)) for i in range(40)]        # small ints → many exact ties
    items = [(i, rng.integers(-2, 3, 6)) for i in range(30)]
    for kw in ({}, {"positive_only": True}):
        want = {k_: v for k_, v in _brute(q, items, 5, **kw).items() if v}
        assert _run(spark, q, items, 5, **kw) == want


def test_topk_multi_block_and_self_exclusion(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vecs = [(i, rng.normal(size=4)) for i in range(25)]
    monkeypatch.setattr(scoring, "ITEM_BLOCK_BYTES", 8 * 4 * 6)      # 6 items per block → 5 blocks
    got = _run(spark, vecs, vecs, 4, exclude_self=True)
    assert got == _brute(vecs, vecs, 4, exclude_self=True)


def test_topk_k_larger_than_catalogue_and_all_mode(spark):
    rng = np.random.default_rng(5)
    q = [(i, rng.integers(-1, 2, 3)) for i in range(10)]
    items = [(i, rng.integers(-1, 2, 3)) for i in range(4)]
    want = {k_: v for k_, v in _brute(q, items, 9, positive_only=True, exclude_self=True).items() if v}
    assert _run(spark, q, items, 9, positive_only=True, exclude_self=True) == want
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in q], "qid long, vec array<double>")
    idf = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in items],
                                "iid long, tie long, vec array<double>")
    every = scoring.topk_dot(qdf, "qid", idf, "iid", "tie", None, positive_only=True).collect()
    assert sorted((r.qid, r.item_id) for r in every) == sorted(
        (qi, ii) for qi, qv in q for ii, iv in items if float(np.dot(qv, iv)) > 0)


def test_group_expansion_matches_item_level_brute_force(spark):
    """Items sharing a vector are scored once per group and expanded to their
    ids inside the task; the result equals ranking every item."""
    rng = np.random.default_rng(9)
    groups = {g: rng.integers(0, 3, 4) for g in range(6)}
    item_group = {i: int(rng.integers(0, 6)) for i in range(40)}
    items = [(i, groups[g]) for i, g in item_group.items()]
    q = [(u, rng.integers(0, 3, 4)) for u in range(25)]
    k = 5
    want = {u: v for u, v in _brute(q, items, k, positive_only=True).items() if v}
    members = {}
    for i, g in sorted(item_group.items()):
        members.setdefault(g, []).append(i)
    rows = [(min(m), min(m), [float(x) for x in groups[g]], m[:k]) for g, m in members.items()]
    idf = spark.createDataFrame(rows, "iid long, tie long, vec array<double>, members array<bigint>")
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in q], "qid long, vec array<double>")
    res = scoring.topk_dot(qdf, "qid", idf, "iid", "tie", k, positive_only=True, members="members") \
        .orderBy("qid", "rank").collect()
    got = {}
    for r in res:
        got.setdefault(r.qid, []).append(r.item_id)
    assert got == want


@pytest.mark.parametrize("block_bytes,dense_limit", [(64 * 1024 * 1024, 2048), (256, 2048), (256, 2)])
def test_content_lists_match_brute_force_with_many_ties(spark, monkeypatch, block_bytes, dense_limit):
    """Signature scoring + in-task expansion + zero fill equal a plain sort of
    every (user, movie) score, on data built to have many equal scores (also
    with tiny candidate blocks, one signature or two per block)."""
    from marquee.operators import hybrid
    monkeypatch.setattr(scoring, "ITEM_BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(scoring, "MAX_DENSE_DIM", dense_limit)      # 2: sparse long-form path
    rng = np.random.default_rng(21)
    vocab = ["a", "b", "c", "d"]
    movies = []
    for m in range(60):
        g = [x for x in vocab if rng.random() < 0.4]
        movies.append((m, g))
    vec_rows = [(m, x, 1.0 / len(g)) for m, g in movies if g for x in g]
    vectors = spark.createDataFrame(vec_rows, "movie_id long, genre string, weight double")
    prof_rows = []
    for u in range(15):
        w = rng.integers(0, 3, len(vocab)).astype(float)
        if w.sum() == 0:
            w[0] = 1.0
        w = w / w.sum()
        prof_rows += [(u, x, float(v)) for x, v in zip(vocab, w) if v > 0]
    profiles = spark.createDataFrame(prof_rows, "user_id long, genre string, weight double")
    universe = spark.createDataFrame([(m,) for m, _ in movies], "movie_id long")
    vec = {}
    for m, x, w in vec_rows:
        vec.setdefault(m, {})[x] = w
    prof = {}
    for u, x, w in prof_rows:
        prof.setdefault(u, {})[x] = w
    n = 7
    for positive_only in (False, True):
        want = {}
        for u, p in prof.items():
            sc = [(round(sum(p.get(x, 0.0) * w for x, w in vec.get(m, {}).items()), 6), m) for m, _ in movies]
            if positive_only:
                sc = [t for t in sc if t[0] > 0]
            want[u] = [m for s, m in sorted(sc, key=lambda t: (-t[0], t[1]))[:n]]
        got = {}
        res = hybrid.content_top_n(profiles, vectors, universe, n, positive_only=positive_only)
        for r in res.orderBy("user_id", "rank").collect():
            got.setdefault(r.user_id, []).append(r.movie_id)
        assert got == {u: v for u, v in want.items() if v}


@pytest.mark.parametrize("slab", [2048, 700])
def test_vocabulary_of_5000_genres(spark, monkeypatch, slab):
    """Similar movies, hybrid lists with factors, content lists and all scores
    equal brute force when there are more genres than one matrix product takes."""
    from marquee.operators import content, hybrid
    monkeypatch.setattr(scoring, "MAX_DENSE_DIM", slab)
    rng = np.random.default_rng(8)
    genres = [f"genre {i}" for i in range(5000)]
    vec = {m: {genres[g]: 0.25 for g in {(m * 7 + i * i) % 5000 for i in range(18)}} | {"common": 0.5} for m in range(330)}
    vec |= {330 + i: {g: 1 / 2500 for g in genres[i::2]} for i in range(2)} | {340: dict(vec[3])}
    prof = {u: {genres[g]: float(w) for g, w in zip(rng.integers(0, 5000, 400), rng.random(400))} for u in range(12)}
    uf, vf = ({i: rng.normal(size=3) for i in ids} for ids in (range(12), vec))
    long = lambda d: [(i, g, float(w)) for i, row in d.items() for g, w in row.items()]
    factors = lambda d, key: spark.createDataFrame(
        [(i, k, float(x)) for i, row in d.items() for k, x in enumerate(row)], f"{key} long, dim int, value double")
    assert len({g for row in vec.values() for g in row}) > 5000
    vectors = spark.createDataFrame(long(vec), "movie_id long, genre string, weight double")
    profiles = spark.createDataFrame(long(prof), "user_id long, genre string, weight double")
    movies = spark.createDataFrame([(m, f"t{m}") for m in vec], "movie_id long, movie_title_id string")
    dot = lambda a, b: sum(w * b.get(g, 0.0) for g, w in a.items())

    def lists(df, key):
        out = {}
        for r in df.orderBy(key, "rank").collect():
            out.setdefault(r[key], []).append((r.movie_id, round(r.score, 6)))
        return out

    def check(got, score, ids, n):
        for i in ids:
            want = sorted((-round(s, 6), m) for m in vec if (s := score(i, m)) is not None)[:n]
            # equal up to the last rounded place
            assert [m for m, _ in got[i]] == [m for _, m in want] and np.allclose([s for _, s in got[i]], [-s for s, _ in want], atol=2e-6)

    check(lists(hybrid.similar_movies(vectors, movies, 5), "query_movie_id"), lambda i, m: None if i == m else dot(vec[i], vec[m]), vec, 5)
    check(lists(hybrid.content_top_n(profiles, vectors, movies, 9), "user_id"), lambda u, m: dot(prof[u], vec[m]), prof, 9)
    users = spark.createDataFrame([(u,) for u in prof], "user_id long")
    counts = spark.createDataFrame([(u, u * 2) for u in prof], "user_id long, n_rated long")
    popular = spark.createDataFrame([(1, 0, 1.0)], "rank int, movie_id long, popularity_score double")
    weights = {r.user_id: (float(r.alpha), float(r.beta)) for r in hybrid.hybrid_weights(users, profiles, counts).collect()}
    blend = lambda u, m: s if (s := weights[u][0] * float(uf[u] @ vf[m]) + weights[u][1] * dot(prof[u], vec[m])) > 0 else None
    top = hybrid.hybrid_recommend(users, profiles, vectors, counts, popular, movies, movies, factors(uf, "user_id"), factors(vf, "movie_id"), 6)
    check(lists(top, "user_id"), blend, prof, 6)
    every = {(r.user_id, r.movie_id): r.score for r in content.cb_scores(profiles, vectors).collect()}
    want = {(u, m): s for u in prof for m in vec if (s := dot(prof[u], vec[m])) > 0}
    assert every.keys() == want.keys() and all(abs(every[p] - want[p]) < 1e-9 for p in want)


def test_pair_dot_scores_only_requested_pairs(spark):
    rng = np.random.default_rng(3)
    users = [(u, f"g{g}", float(rng.random())) for u in range(40) for g in rng.choice(300, 12, replace=False)]
    movies = [(m, f"g{g}", float(rng.random())) for m in range(60) for g in rng.choice(300, 1 + m % 40, replace=False)]
    # one user in half the pairs, repeated pairs, ids without a vector, null ids
    pairs = [(0, m) for m in range(60)] * 3 + [(u, (7 * u) % 60) for u in range(45)] + [(3, 999), (None, 1), (1, None)]
    left = spark.createDataFrame(users, "user_id long, genre string, weight double")
    right = spark.createDataFrame(movies, "movie_id long, genre string, weight double")
    got = scoring.pair_dot(spark.createDataFrame(pairs, "user_id long, movie_id long"), left, "user_id", right, "movie_id", "genre", "weight")
    u, m = {}, {}
    for d, rows in ((u, users), (m, movies)):
        for i, g, w in rows:
            d.setdefault(i, {})[g] = w
    want = {(a, b): sum(w * m[b][g] for g, w in u[a].items() if g in m[b]) for a, b in set(pairs)
            if a in u and b in m and set(u[a]) & set(m[b])}
    rows = got.collect()
    assert len(rows) == len(want) and got.columns == ["user_id", "movie_id", "score"]
    assert all(abs(r.score - want[r.user_id, r.movie_id]) < 1e-9 for r in rows)
    empty = spark.createDataFrame([], "user_id long, movie_id long")
    assert scoring.pair_dot(empty, left, "user_id", right, "movie_id", "genre", "weight").count() == 0


def test_hot_pairs_in_view_counts(spark):
    from marquee.operators import content, evaluation
    watch = spark.range(20000).selectExpr("if(id % 2 = 0, 1, id) as user_id", "if(id % 2 = 0, 5, id % 7) as movie_id", "3 as watched_minutes")
    freq = content.watch_frequency(watch)
    assert freq.count() == 20000
    assert freq.where("user_id = 1 and movie_id = 5").select("watch_frequency").distinct().first()[0] == 10000
    recs = spark.createDataFrame([(1, 5, 1), (2, 5, 1)], "user_id long, movie_id long, rank int")
    assert tuple(evaluation.cf_accuracy(recs, watch, 10).first()) == (0.5, 10000 / 20, 2)


def test_cb_scores_expands_lists_of_movies(spark, monkeypatch):
    """Movies of a signature come as arrays of about MEMBERS ids, rounded once per signature: no
    row of the output is joined by itself."""
    monkeypatch.setattr(content, "MEMBERS", 2)
    profiles = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.3), (2, "b", 1.0), (3, "z", 1.0)], "user_id long, genre string, weight double")
    genres = {m: ("a",) if m < 8 else ("a", "b", "c") for m in range(10)}
    vectors = spark.createDataFrame([(m, g, 1 / len(gs)) for m, gs in genres.items() for g in gs], "movie_id long, genre string, weight double")
    own = {1: {"a": 0.7, "b": 0.3}, 2: {"b": 1.0}}
    want = {(u, m): sum(p.get(g, 0) / len(gs) for g in gs) for u, p in own.items() for m, gs in genres.items()}
    got = content.cb_scores(profiles, vectors, decimals=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(members") < plan.index("Join")
    rows = [(r.user_id, r.movie_id, r.score) for r in got.collect()]
    assert len(rows) == len(set(rows)) and sorted(rows) == sorted((u, m, round(s, 2)) for (u, m), s in want.items() if s > 0)


def _cell(items, queries, names, k, **kw):
    """One cell through the worker's code: ``items`` (id, vec, {key: weight}), ``queries`` alike."""
    import pyarrow as pa
    kinds = {"vec": pa.list_(pa.float64()), "keys": pa.list_(pa.string()), "weights": pa.list_(pa.float64())}

    def batch(rows, side):
        ids = pa.array([r[0] for r in rows], pa.int64())
        none = pa.nulls(len(rows), pa.int64())
        cols = {"cell": pa.array(np.zeros(len(rows), np.int32)), "side": pa.array(np.full(len(rows), side, np.int32)),
                "q": none if side == 0 else ids, "id": ids if side == 0 else none, "tie": ids if side == 0 else none,
                "vec": [list(map(float, r[1])) for r in rows], "keys": [list(r[2]) for r in rows], "weights": [list(r[2].values()) for r in rows]}
        return pa.RecordBatch.from_pydict({c: cols[c] if c not in kinds else pa.array(cols[c], kinds[c])
                                           for c in ("cell", "side", "q", "id", "tie", *names)})

    run = scoring._score_cells(names, k, kw.get("positive_only", False), kw.get("exclude_self", False), None)
    return sorted((q, -round(s, 6), i) for b in run(iter([batch(items, 0), batch(queries, 1)]))
                  for q, i, s in zip(*(b.column(c).to_pylist() for c in ("q", "item_id", "score")), strict=True))


@pytest.mark.parametrize("names", [["vec"], ["keys", "weights"], ["vec", "keys", "weights"]])
@pytest.mark.parametrize("kw", [{}, {"positive_only": True}, {"exclude_self": True}])
@pytest.mark.parametrize("block_bytes", [64 * 1024 * 1024, 256])
def test_best_of_small_products_with_many_ties(monkeypatch, names, kw, block_bytes):
    """Products of 5 rows by 7 items, scores that tie within and across them, rising and falling
    with the id, with frequent and rare keys (256 bytes: rare ones only): equal to ranking every pair."""
    for name, value in (("SCREEN_ROWS", 5), ("SCREEN_ITEMS", 7), ("ITEM_BLOCK_BYTES", block_bytes)):
        monkeypatch.setattr(scoring, name, value)
    rng = np.random.default_rng(4)
    row = lambda i: (i, rng.integers(-2, 3, 3) + (i // 40 - 1), {f"k{j}": float(rng.integers(-1, 3)) for j in rng.choice(9, i % 5, replace=False)})
    items, queries = [row(i) for i in range(120)], [row(i) for i in range(33)]

    def score(a, b):
        return (float(a[1] @ b[1]) if "vec" in names else 0.0) + (sum(w * b[2].get(g, 0.0) for g, w in a[2].items()) if "keys" in names else 0.0)

    want = []
    for q in queries:
        all_of = ((-round(score(q, i), 6), i[0]) for i in items if not (kw.get("exclude_self") and i[0] == q[0]))
        want += [(q[0], *x) for x in sorted(x for x in all_of if x[0] < 0 or not kw.get("positive_only"))[:4]]
    assert _cell(items, queries, names, 4, **kw) == sorted(want)


def test_few_pairs_are_ranked(monkeypatch):
    """Scores are compared with a bound: less than a tenth of the pairs is rounded or cut by rank."""
    rng = np.random.default_rng(6)
    items = [(i, rng.random(6), {f"g{j}": 0.5 for j in rng.choice(20, 2, replace=False)}) for i in range(40000)]
    queries = [(i, rng.random(6), {f"g{j}": 0.1 for j in rng.choice(20, 9, replace=False)}) for i in range(60)]
    seen = []
    for name in ("round", "partition"):
        def spy(a, *args, _own=getattr(np, name), **kw):
            seen.append(np.size(a))
            return _own(a, *args, **kw)
        monkeypatch.setattr(scoring.np, name, spy)
    got = _cell(items, queries, ["vec", "keys", "weights"], 20, positive_only=True)
    assert 0 < sum(seen) < len(items) * len(queries) / 10
    vec, q = np.array([i[1] for i in items]), queries[7]
    s = vec @ q[1] + np.array([sum(w * q[2].get(g, 0.0) for g, w in i[2].items()) for i in items])
    assert [i for r, _, i in got if r == 7] == [i for _, i in sorted(zip(-np.round(s, 6), range(len(s))))[:20]]
