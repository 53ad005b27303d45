"""Phrase collocations against counting by hand."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from marquee.llm import collocations

SCHEMA = "doc_id long, text string, lang string, word string, f long, n long, phrase string, shard long"


def brute(rows, least=10, covered=50, top=2000):
    f = {}
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        cands = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        over = Counter()
        for p, c in cands.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    over[q] = max(over[q], c)
        kept = []
        for p, a in cands.items():
            if len(p) == 2 and p in over and 100 * over[p] >= covered * a:
                continue
            score, k = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts():
    rng = random.Random(3)
    words = ["New", "new", "york", "CITY", "état", "x\x0by", "a", "b", "of", "the", "\x1cz", "日本"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "de", None, "und"])) for _ in range(500)]
    return [*rows, (None, "en"), ("", None), ("a a a a a a a a a a a a a a a", "fr"), ("solo " * 9, "es"), rows[0], rows[0]]


@pytest.mark.parametrize("shard", [8 << 20, 300])
def test_collocations(spark, shard):
    df = spark.createDataFrame([(i, t, lang, "w", 1, 1, "p", 1) for i, (t, lang) in enumerate(texts())], SCHEMA)
    got = sorted(tuple(r) for r in collocations.collocations(df, shard_bytes=shard).collect())
    want = brute(texts())
    assert got == want and len(want) > 50
    assert sorted(tuple(r) for r in collocations.collocations(df, top=4).collect()) == brute(texts(), top=4)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).count() == 0


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_index_counts_all_phrases(depth):
    seq = np.random.default_rng(5).integers(0, 5, 400)
    want = Counter(tuple(map(int, seq[i:i + k])) for k in range(2, depth + 1) for i in range(len(seq) - k + 1) if 0 not in seq[i:i + k])
    got, filters = {}, {}
    for length in range(2, depth + 1):
        words, counts = collocations.phrases(seq, length, filters)
        got.update({tuple(map(int, w)): int(c) for w, c in zip(words, counts, strict=True)})
        often = words[counts >= 14]
        filters[length] = np.zeros(collocations.FILTER_BITS // 64, np.uint64)
        slot = collocations._slots(often)
        np.bitwise_or.at(filters[length], slot >> 6, np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)))
    # nothing frequent is lost, and what is left has its whole count
    assert all(want[p] == c for p, c in got.items()) and all(p in got for p, c in want.items() if c >= 14 or len(p) == 2)
    if depth > 2:
        assert len(got) < len(want)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 4_000_000_000_007, 4_000_000_000_011, 5_000_000_000_003
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations._score("a", "l", "r").alias("s")).first().s == 10 ** 6 * a * a // (left * right)


def test_long_texts_are_cut_between_pieces():
    for text in (b"a b c. d e, f g\nh" * 5, b"x" * 50, b"x" * 50 + b"." + b"y" * 30):
        parts = list(collocations._stretches(text, 10))
        assert b"".join(parts) == text and all(p[-1:] in collocations._PIECE_END for p in parts[:-1])
