"""Tokenizer alignment against a plain merge of the two libraries' tokens."""
import hashlib
from collections import Counter

import pytest

from marquee.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, chunk long, pair long, n long, best boolean"
TEXTS = [None, "", " ", "  ", "a ", " a  b \n\n  c\t d ", "x  y　 z", "é à ü ", "<|endoftext|> <s> <unk> <0x41>", "▁ x", "a▁b ok", "  q",
         "日本語 テスト 漢字", "😀 👍🏽  z\r\n ", "it's we'll 'S don't", "w" * 3000 + " " + "1" * 300, "a\x1c b", "ﬁ ﬀ ①", "the cat sat", "the cat sat",
         "the cat " * 2000, "nothing but\n\n\n lines \n here"]


@pytest.fixture(scope="module")
def vocab():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.Vocabularies(a.read(), b.read())


def brute(texts, v):
    docs = []
    for t in texts:
        a = v.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = v.b.encode(t) if t else []
        groups, i, j, at_a, at_b, own_a, own_b = [], 0, 0, 0, 0, [], []
        if not t or any(b"".join(table[k] for k in ids) != (" " + t).encode() for table, ids in ((v.a_bytes, a), (v.b_bytes, b))):
            a, b = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                own_a.append(a[i])
                at_a, i = at_a + len(v.a_bytes[a[i]]), i + 1
            else:
                own_b.append(b[j])
                at_b, j = at_b + len(v.b_bytes[b[j]]), j + 1
            if at_a == at_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        docs.append((a, b, groups))
    count = Counter((g[0][-1], g[1][-1]) for d in docs for g in d[2])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for a, b, groups in docs:
        links = [(x[-1], y[-1]) for x, y in groups]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(groups), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("chunk,stretch", [(2 << 20, 1024), (200, 7)])
def test_alignment_of_awkward_texts(spark, vocab, chunk, stretch):
    df = spark.createDataFrame([(i, t, "en", 0, 0, 0, True) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_tokenizers(df, chunk_bytes=chunk, stretch=stretch).collect()}
    assert got == dict(enumerate(brute(TEXTS, vocab)))


def test_alignment_of_documents(spark, vocab):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_tokenizers(df).collect()}
    assert got == dict(zip([i for i, _ in rows], brute([t for _, t in rows], vocab), strict=True))


def test_repeated_and_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one two"), (3, "one two"), (3, "one two")], "doc_id long, text string")
    rows = alignment.align_tokenizers(df).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [None, 3, 3] and len({tuple(r)[1:] for r in rows}) == 1
    assert alignment.align_tokenizers(df.limit(0)).count() == 0


def test_words_join_to_whole_texts(vocab):
    for text in filter(None, TEXTS):
        a, b = vocab.encode(text)
        if len(a):
            assert a.tolist() == vocab.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == vocab.b.encode(text)
