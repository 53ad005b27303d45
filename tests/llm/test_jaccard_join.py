"""The exact n-gram join against brute force, and its pigeonhole bounds."""
import random

import numpy as np
import pytest

from marquee.llm import jaccard_join as jj

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row long, digest string, keys string, k1 long, node long"


def shingles(text, n=jj.WORDS):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent=jj.PERCENT):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts():
    rng = random.Random(11)
    word = lambda p: f"{p}{rng.randrange(10 ** 5)}"
    out = [None, "", " \n", "one two", "One TWO", "one two three", "a b c d e", "a b c d e f", "a b c d e f g h i", "z b c d e f g h i"]
    passage = [word("p") for _ in range(30)]
    for size in (8, 14, 20, 35, 60, 120, 300):  # chains of small edits at every size, around the threshold
        base = [word("w") for _ in range(size)]
        for k in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, size // 18))):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], [word("n")], [words[at], word("n")]])
            out.append(" ".join(words + (passage if k % 5 == 0 else [])))
        out += [" ".join(base[:-1]), " ".join(base + base[:3]), " ".join(base)]
    for _ in range(20):
        out.append(" ".join([word("x") for _ in range(rng.randrange(2, 40))] + passage))
    return [*out, " ".join(f"w{i % 977}x{i % 13}" for i in range(30000)), " ".join(f"w{i % 977}x{i % 13}" for i in range(30000)) + " tail"]


def test_components_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 0, "d", "k", 1, 2) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join_components(df).collect()}
    want = brute(rows)
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 60


def test_documents_equal_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join_components(df).collect()} == brute(rows)


def test_null_and_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "q r s t"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jj.join_components(df).collect())
    assert got == sorted([("None", "4"), ("4", "4"), ("4", "4"), ("None", "None"), ("2", "2")])
    assert jj.join_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [6, 7, 11, 12, 19, 40, 110, 281, 282, 900])
def test_every_linked_pair_shares_an_index_key(size):
    """Pairs at the largest difference allowed meet among the keys that each is indexed under, whatever the
    rarity of the keys."""
    rng = np.random.default_rng(size)
    for trial in range(25):
        union = rng.integers(0, 2 ** 63, 2 * size + 8, dtype=np.uint64)
        x = union[:size]
        gone = rng.integers(0, size * 15 // 100 + 1)
        y = x[gone:]
        room = 0
        while 100 * len(y) >= 85 * (size + room + 1):
            room += 1
        y = np.concatenate([y, union[size:size + rng.integers(0, room + 1)]])
        if not len(y) or 100 * (size - gone) < 85 * (gone + len(y)):
            continue
        small, met = min(len(x), len(y)), False
        if len(x) == len(y) == len(set(map(int, x)) & set(map(int, y))):
            continue  # equal sets are one node
        assert jj.band_of(small) in jj.bands(len(x)) and jj.band_of(small) in jj.bands(len(y))
        with np.errstate(over="ignore"):
            (a, deletions), (b, _) = (jj.part_keys(np.unique(s), jj.band_of(small)) for s in (x, y))
        order = lambda k: hash((trial, int(k)))  # noqa: B023, E731
        if not deletions:
            a, b = (sorted(k, key=order)[:jj.differing(len(s)) + 1] for k, s in ((a, x), (b, y)))
        met = bool(set(map(int, a)) & set(map(int, b)))
        assert met


def test_sets_that_only_equal_ones_are_similar_to_have_no_keys():
    assert [s for s in range(1, 40) if not jj.bands(s)] == [s for s in range(1, 40) if 100 * s < 85 * (s + 1)]


def test_bands_are_contiguous():
    for size in range(1, 3000):
        band = jj.band_of(size)
        assert jj.first_size(band) <= size < jj.first_size(band + 1)
    assert [jj.first_size(b) for b in range(4)] == sorted({jj.first_size(b) for b in range(4)})


def test_class_rows_are_found_by_their_few_copies(spark, monkeypatch):
    """Only ids of copies are joined with the rows and their keys, not the ids of all classes."""
    made, real = {}, jj.materialize

    def recorded(df, name="stage"):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(jj, "materialize", recorded)
    distinct = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)]
    rows = distinct + [(100, distinct[3][1]), (101, distinct[3][1].upper()), (102, distinct[7][1]), (7, distinct[7][1]), (103, None), (104, " ")]
    got = jj.join_components(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    to = {100: 3, 101: 3, 102: 7}
    assert found == sorted((i, 27 if i < 103 else 0, to.get(i, i)) for i, _ in rows)
    assert made["copies"].count() == 4
    assert made["nodes"].select("node").distinct().count() == made["nodes"].count() == 20
