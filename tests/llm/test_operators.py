"""The training-data operators against brute force on small fixtures with the awkward cases."""
import array
import hashlib
import random
import re
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marquee.llm import bpe, components, licenses, near_dup, packing, pii, quality, repeats, topk, warc
from marquee.llm import block_naming as bn

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, name string"


def table(spark, texts, first=0):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or ""), False, "x") for i, t in enumerate(texts)], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
AWKWARD = [None, "", " \n", "one two three", "one two three", "a b c d e f g h", "a b c d e f g h", LONG, LONG + " tail", "é" * 500, "é" * 500]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- exact dedup
def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("block", [3, 2048])
def test_block_naming(spark, docs, block):
    got = {tuple(r) for r in bn.exact_dedup(docs, block_chars=block).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert got == brute_copies(list(enumerate(AWKWARD)))


def test_block_naming_repeated_rows_and_null_ids(spark, empty):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = bn.exact_dedup(df).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows) == 2
    assert {r.keep_id for r in rows if r.group_size == 3} == {1}
    assert sorted(bn.drop_copies(df).collect(), key=str) == sorted(df.distinct().where("doc_id = 1 or text = 'b'").collect(), key=str)
    assert bn.exact_dedup(empty).count() == 0 and bn.drop_copies(empty).columns == empty.columns


# ---------------------------------------------------------------- near duplicates
def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_texts():
    rng = random.Random(4)
    base = [f"v{rng.randrange(400)}" for _ in range(120)]
    out = []
    for k in range(60):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(120)] = f"n{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out + [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(40)) for _ in range(20)]


def test_near_duplicates(spark, empty):
    texts = AWKWARD + near_texts() + ["A b C d e f G h", "a\tb\x0bc  d e f g h"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_match_brute_force_on_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    assert near_dup.keep_one(df).count() == sum(v[2] for v in got.values())


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# ---------------------------------------------------------------- repeated strings
def brute_repeats(rows, n=repeats.LENGTH):
    seen, twice = set(), set()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for p in range(len(b) - n + 1):
            h = b[p:p + n]
            (twice if h in seen else seen).add(h)
    out = {}
    for i, b in data:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - n + 1):
            if b[p:p + n] in twice:
                gone[p] += 1
                gone[p + n] -= 1
        mask = np.cumsum(gone)[:len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[i] = (len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings(spark, empty):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = word(450)
    texts = [None, "", word(399), "ab" * 700, "z" * 500, "z" * 399, passage, word(50) + passage + word(60), word(10) + passage[:410],
             passage[25:425], passage[30:420], word(800), "é" * 300]
    texts += [texts[11][:500] + word(100) + texts[11][500:], word(700), None]
    texts.append(texts[14])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))
    assert repeats.remove_repeats(empty).count() == 0


def test_repeated_strings_in_segments(spark, monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcdefghij") for _ in range(9000))
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    found = [(at + int(s), int(lo), int(hi)) for at, part in repeats._segments(text)
             for _, s, lo, hi, _, _ in zip(*repeats.runs([part]), strict=True)]
    covered = sorted(p for s, lo, hi in found for p in range(s, s + hi - lo + 1))
    assert covered == list(range(len(text) - repeats.LENGTH + 1))


# ---------------------------------------------------------------- BPE and packing
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tok, text):
    return list(tok.encode(text or "", add_special_tokens=False).ids)


MIXED = ["ΟΔΟΣ Σ İstanbul don't we'll", "<|endoftext|>a<|startoftext|> b<|x", "tab\x1fsep\x85end wide", "x" * 3000, "éé 12３4 !!??"]


def test_bpe_equals_the_library(spark, docs, empty):
    tok = library()
    texts = AWKWARD + MIXED
    for r in bpe.round_trip(table(spark, texts)).collect():
        want = ids_of(tok, texts[r.doc_id])
        assert list(array.array("I", bytes(r.ids))) == want
        assert r.decoded == tok.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(empty).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 25): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums)
        assert all(k <= counts[n] for n, k in got.items())


def check_packing(rows, want, capacity):
    pieces = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert pieces == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, empty):
    tok = library()
    texts = AWKWARD + MIXED
    want = {}
    for i, t in enumerate(texts):
        ids = [*ids_of(tok, t), 1]
        for k, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = array.array("I", ids[at:at + packing.CAPACITY])
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = packing.pack(table(spark, texts)).collect()
    n = check_packing(rows, want, packing.CAPACITY)
    assert n <= -(-sum(w[1] for w in want.values()) // packing.CAPACITY) + 1
    assert packing.pack(empty).count() == 0
    small = bpe.pieces(table(spark, texts), packing.CAPACITY, packing.END_ID, entries=3)
    assert sorted(small.collect()) == sorted(r[:5] for r in rows)


# ---------------------------------------------------------------- personal data
def brute_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_patterns_equal_plain_regex():
    rng = random.Random(6)
    for _ in range(20000):
        text = "".join(rng.choice("0192 5.@a-+()%é\n_") for _ in range(rng.randrange(1, 45)))
        assert pii.base_spans(text)[0] == brute_base(text), text


def test_long_runs_are_linear():
    for text in ("a" * 200000, "1" * 200000, "@" * 200000, "a@" * 100000, "+1" * 100000, "1." * 100000, "+1" + "(" * 200000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_tagger_finds_spans_it_was_not_given(spark, tagger, monkeypatch):
    # trained on one table, read on texts of another
    other = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").subtract(other).collect()]
    spans = [(t, s) for t in rows for s in pii.base_spans(t)[0]]
    with monkeypatch.context() as m:  # what is decoded; the confidence bound is for what is added
        m.setattr(pii, "CONFIDENT", -1e9)
        hit = sum(s in {x for _, x in pii.decoded(tagger, t)} for t, s in spans)
    assert len(spans) > 50 and hit > 0.8 * len(spans), (hit, len(spans))
    clean = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("not text rlike '[0-9@]'").collect()]
    assert not any(pii.all_spans(t, tagger)[1] for t in clean)


def test_tagger_learns_every_kind_of_a_table_with_few(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, codes, tags: seen.append((codes, tags)))
    rare = ["mail jo.doe@mail.example.org today", "host 10.20.30.40 is down", "card 4565 4101 2566 7261 expired", "call +44 20 7946 0958 now"]
    texts = [f"order {i} of {i % 7} parts" for i in range(6000)] + rare
    assert pii.train(table(spark, texts).repartition(5)) is not None
    codes, tags = seen.pop()
    assert {(int(t) + 1) // 2 for t in np.unique(tags)} == {0, 1, 2, 3, 4}
    assert len(codes) <= pii.TRAIN_WINDOWS * 3 // 2 and (~tags.any(axis=1)).sum() > 100
    many = [f"u{i}@mail.example.org " * 9 for i in range(900)]  # one kind does not push the others out
    pii.train(table(spark, many + rare))
    assert {(int(t) + 1) // 2 for t in np.unique(seen.pop()[1])} == {0, 1, 2, 3, 4}
    with pytest.warns(UserWarning, match="ip, card, phone"):
        assert pii.train(table(spark, many)) is not None
    with pytest.warns(UserWarning, match="email, ip, card, phone"):
        assert pii.train(table(spark, texts[:50])) is None


def test_pii_find_and_mask(spark, docs, empty, tagger):
    texts = AWKWARD + ["mail a.b@c.example.org, call +1 (386) 555-3733 or 4565 4101 2566 7261 at 10.0.0.256"]
    rows = {r.doc_id: r for r in pii.find(table(spark, texts), tagger).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert rows[i].base == pii.listed(base) and [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
        assert set(filter(None, rows[i].base.split(","))) <= set(rows[i].spans.split(","))
    masked = pii.mask(table(spark, texts), tagger)
    assert masked.columns == docs.columns
    last = masked.where("doc_id = 11").first().text
    assert "[EMAIL]" in last and "[PHONE]" in last and "555" not in last
    assert masked.where("doc_id = 0").first().text is None
    assert pii.find(empty, tagger).count() == 0 and pii.train(empty) is None and pii.mask(empty, None).count() == 0


def test_overlapping_windows_cover_what_is_near_a_digit():
    text = "x" * 500 + "12" + "y" * 90 + "3" + "z" * 300
    starts = pii.windows(text)
    near = {p for m in re.finditer("[0-9]", text) for p in range(m.start() - pii.REACH, m.start() + pii.REACH)}
    assert near <= {p for s in starts for p in range(s, s + pii.WINDOW)}


# ---------------------------------------------------------------- quality
def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95


def test_quality_awkward_rows(spark, docs, empty):
    lab = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, lab).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.classify(empty, lab).count() == 0
    none = quality.classify(docs, lab.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(docs, lab.where("false")).columns == docs.columns


def test_quality_reads_long_texts_whole(monkeypatch):
    model = quality.Attention()
    model.theta["c"] = np.linspace(-1, 1, model.HIDDEN)
    text = (LONG * 3).encode()
    one = model.score([text])
    monkeypatch.setattr(quality, "SLICE", quality.PASSAGE_BYTES * 16)
    assert np.allclose(one, model.score([text]))


# ---------------------------------------------------------------- top k
def brute_top(rows, k):
    out = []
    for q, qv in rows:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(1)
    vecs = [list(map(float, rng.normal(0, 1, 6) * (10 if i % 9 == 0 else 1))) for i in range(300)]
    vecs[50:120] = [vecs[40]] * 70  # one frequent vector: ties go to the smaller id
    vecs += [[0.0] * 6, [1.0, 2.0], [2.0, 1.0]]
    rows = list(enumerate(vecs))
    rows += [(320, [3.0, 4.0]), (340, [0.0] * 6)]
    bad = [(360, None), (361, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (380, [float("nan")] * 6), (381, [float("inf")] * 6), (None, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, score string")
    ints = topk.integers(df)
    got = sorted(tuple(r) for r in topk.top_k(ints, ints.where("vec_id % 20 = 0"), 20).collect())
    assert got == brute_top([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows], 20)
    none = topk.integers(df.where("false"))
    assert topk.top_k(none, none, 20).count() == 0


def test_pruning_never_loses_a_vector():
    rng = np.random.default_rng(3)
    for _ in range(200):
        rows = rng.integers(-50, 50, (80, 5))
        norms = np.sqrt((rows ** 2).sum(1).astype(float))
        rows, norms = rows[np.argsort(-norms)], np.sort(norms)[::-1]
        q = rng.integers(-50, 50, 5)
        scores = rows @ q
        bound = float(np.sort(scores)[-rng.integers(1, 20)])
        kept = topk.candidates(rows, norms, q, float(np.sqrt((q ** 2).sum())), bound)
        assert set(np.flatnonzero(scores >= bound)) <= set(kept)


# ---------------------------------------------------------------- WARC and licences
def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(3, "http://a/", "<p>é</p>", 1), (1, "http://b/\nWARC-Type: revisit", "<p>é</p>", 1), (2, None, None, 1), (5, "u", "", 1), (None, "n", "x", 1),
         (7, "u", "x", 1), (7, "u", "x", 1)], "page_id long, url string, html string, header int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(pages).collect()), key=str)
    assert got == sorted([(3, 9, "revisit", 1), (1, 9, "response", None), (2, 0, "response", None), (5, 0, "revisit", 2), (None, 1, "revisit", 7),
                          (7, 1, "response", None), (7, 1, "revisit", 7)], key=str)
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, min_revisit_bytes=5)
    back = warc.read_archive(spark, path).collect()
    assert {r.record_id for r in back if b"\nWARC-Type: revisit\r\n" in bytes(r.record)} == {3}
    for r in back:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body == bytes(r.payload)[:length] + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    assert warc.page_records(pages.where("false")).count() == 0


def brute_license(text):
    units = (text or "").split("\n")
    units = [(k, u) for k, u in enumerate(units)] + ([(-1, text)] if len(units) > 1 else [])
    hits = []
    for k, u in units:
        own = set(licenses.bigrams(u))
        found = []
        for t, body in enumerate(licenses.TEMPLATES.values()):
            other = set(licenses.bigrams(body))
            dice = 2 * len(own & other) / (len(own) + len(other))
            if dice >= licenses.THRESHOLD / 100:
                found.append((-dice, t, k if k >= 0 else 10 ** 9))
        if found:
            hits.append(min(found))
    if not hits:
        return 0, None, None, None
    dice, t, k = min(hits)
    return len(hits), list(licenses.TEMPLATES)[t], round(-dice, 6), -1 if k == 10 ** 9 else k


def test_license_scan(spark, empty):
    texts = AWKWARD[:7] + ["intro\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT license", licenses.TEMPLATES["MPL-2.0"].replace(". ", ".\n"),
                           "Licensed under CC BY 4.0", "LICENSED under   the-apache license; version 2 0 now", "the the the the"]
    got = {r.doc_id: (r.n_matches, r.license, r.dice, r.unit) for r in licenses.scan(table(spark, texts)).collect()}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    assert licenses.scan(empty).count() == 0


def brute_windows(text, templates):
    """Lines and the whole text, then greedily the best windows that share no word with what was taken."""
    lines, at, spans = (text or "").split("\n"), 0, []
    for line in lines:
        spans.append((at, at := at + len(licenses.words(line))))
    spans += [(0, at)] if len(lines) > 1 else []
    w = licenses.words(text or "")
    grams = [set(licenses.bigrams(t)) for t in templates.values()]
    dice = lambda own, g: 2 * len(own & g) / (len(own) + len(g)) if own else 0
    own = lambda a, b: {f"{x} {y}" for x, y in zip(w[a:b], w[a + 1:b])}
    found, taken = [], set()
    for unit, (a, b) in enumerate(spans):
        best = max((dice(own(a, b), g), -k) for k, g in enumerate(grams))
        if best[0] >= 0.8:
            found.append((-best[0], -best[1], unit))
            taken |= set(range(a, b))
    every = sorted((-d, k, b, -a) for k, g in enumerate(grams) for a in range(len(w)) for b in range(a + 2, min(len(w), a + licenses.size_bounds(len(g))[1] + 1) + 1)
                   if (d := dice(own(a, b), g)) >= 0.8)
    for d, k, b, a in every:
        if not taken & set(range(-a, b)):
            taken |= set(range(-a, b))
            found.append((d, k, next(i for i, (x, y) in enumerate(spans) if x <= -a < y)))
    if not found:
        return 0, None, None, None
    d, k, unit = min(found)
    return len(found), list(templates)[k], round(-d, 6), -1 if unit == len(lines) else unit


def test_license_windows_equal_brute_force(spark):
    rng = random.Random(4)
    templates = {"a": "p q r s t", "b": "r s t u v w x", "c": "p q p q r", "d": "s t u v"}
    texts = ["".join(rng.choice("pqrstuvwxyz") + rng.choice(["  ", " ", " ", ", ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += ["".join(rng.choice(["p q r s t", "r s t u v w x", "p q r", "s t\nu v", "z", "y\n"]) + " " for _ in range(rng.randrange(12))) for _ in range(250)]
    got = {r.doc_id: (r.n_matches, r.license, r.dice, r.unit) for r in licenses.scan(table(spark, texts).coalesce(2), templates=templates).collect()}
    want = {i: brute_windows(t, templates) for i, t in enumerate(texts)}
    assert got == want and sum(n > 1 for n, *_ in want.values()) > 100


def test_license_notices_that_wrap_or_stand_in_a_sentence(spark):
    prose, mit = " ".join(f"word{i} other{i}" for i in range(400)), licenses.TEMPLATES["MIT-text"]
    wrapped = textwrap.fill(mit, 78)
    full = licenses.TEMPLATES["MIT-full"].replace("<year> <copyright holders>", "2024 Jane Doe")
    texts = [f"{prose}\n{wrapped}\n{prose}",
             "/*\n" + "\n".join(f" * {x}" for x in wrapped.split("\n")) + f"\n */\n{prose}",
             "Copyright 2024 Jane Doe. Licensed under the Apache License, Version 2.0. See the file for all details.",
             f"{prose} see below: this work is licensed under the GNU General\nPublic License, version 3. {prose}",
             textwrap.fill(full, 60), licenses.TEMPLATES["GPL-3.0-full"], f"{prose}\n{licenses.TEMPLATES['Apache-2.0-full']}\n{prose}",
             f"{prose} Licensed under CC BY\n4.0. {prose} Released under the\nMIT License. {prose}", prose]
    got = [(r.n_matches, r.license, r.unit) for r in licenses.scan(table(spark, texts)).orderBy("doc_id").collect()]
    assert got[:4] == [(1, "MIT-text", 1), (1, "MIT-text", 1), (1, "Apache-2.0", 0), (1, "GPL-3.0", 0)]
    assert got[4][1:] == ("MIT-full", -1) and got[5][1:] == ("GPL-3.0-full", -1) and got[6][1:] == ("Apache-2.0-full", 2)
    assert got[7] == (2, "MIT", 1) and got[8] == (0, None, None)


def test_size_bounds_are_tight():
    for n in range(1, 60):
        low, high = licenses.size_bounds(n)
        assert [m for m in range(1, 200) if 200 * min(m, n) >= licenses.THRESHOLD * (m + n)] == list(range(low, high + 1))


def test_top_k_broadcasts_no_blocks(spark):
    from marquee.llm import topk

    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    ints = topk.integers(rows)
    got = topk.top_k(ints, ints.where("vec_id % 20 = 0"), 3)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 9
