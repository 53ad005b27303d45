"""Null ids, repeated rows and clashing column names in the stages of the pipeline."""
import numpy as np
import pytest

from marquee.llm import block_naming, near_dup, quality

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_columns_with_helper_names_are_kept(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = documents.selectExpr("*", "doc_id * 2 as _quality", "doc_id * 3 as _kept_sha", "doc_id * 5 as kept_id", "doc_id * 7 as k1", "doc_id * 9 as comp")
    for out in (quality.keep_good(odd, labels), block_naming.drop_copies(odd), near_dup.keep_one(odd)):
        assert out.columns == odd.columns
        assert out.where("_quality <> doc_id * 2 or _kept_sha <> doc_id * 3 or kept_id <> doc_id * 5 or k1 <> doc_id * 7 or comp <> doc_id * 9").count() == 0
        assert 0 < out.count() <= odd.count()


def test_near_copies_under_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    base = " ".join(base)
    rows = [(None, base), (None, near), (5, "a b c d e f"), (5, base), (5, near), (7, near), (None, "alone here"), (None, None), (8, ""), (9, "a b c d e f")]
    kept = [tuple(r) for r in near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    ours = [r for r in kept if r[1] in (base, near)]
    assert len(ours) == 1 and ours[0][0] == 5
    assert {r for r in kept if r[1] not in (base, near)} == {
        (5, "a b c d e f"), (None, "alone here"), (None, None), (8, "")}
    nobody = spark.createDataFrame([(None, base), (None, near)], "doc_id long, text string")
    assert near_dup.keep_one(nobody).count() == 1
    assert {r.component_id for r in near_dup.near_duplicates(nobody).collect()} == {None}


def test_a_sampled_id_that_repeats_is_one_training_row(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    taught = labels.where("quality = 1").where(quality._fold(labels["doc_id"]) != 0).first().doc_id
    copies = documents.where(f"doc_id = {taught}").crossJoin(spark.range(2000).select()).unionByName(documents.where(f"doc_id <> {taught}"))
    assert copies.count() > 2000
    one, two = (quality.train(d, labels) for d in (documents, copies))
    assert all(np.allclose(one.theta[k], two.theta[k]) for k in one.theta)


def test_training_passages_are_bounded(spark, documents, monkeypatch):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    monkeypatch.setattr(quality, "TRAIN_PASSAGES", 30)
    seen = []
    monkeypatch.setattr(quality.Attention, "fit", lambda self, bags, y: seen.append(sum(map(len, bags))))
    quality.train(documents, labels)
    assert 0 < seen[0] <= 30


def test_scores_equal_a_plain_computation(spark, documents):
    """Gated attention written out passage by passage."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(documents, labels)
    t = model.theta

    def plain(text):
        data = text.encode()
        h = []
        for at in range(0, max(1, len(data)), quality.PASSAGE_BYTES):
            part = np.frombuffer(data[at:at + quality.PASSAGE_BYTES], np.uint8)
            x = quality.features(part, np.zeros(len(part), np.int64), 1)[0]
            h.append(np.tanh(((x - t["mean"]) * t["scale"]) @ t["E"] + t["b"]))
        h = np.array(h)
        a = (np.tanh(h @ t["V"]) / (1 + np.exp(-(h @ t["U"])))) @ t["w"]
        weight = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        return 1 / (1 + np.exp(-((weight @ h) @ t["c"] + t["c0"][0])))

    for row in quality.score(documents.select("text"), model).collect():
        assert abs(row.score - plain(row.text or "")) < 1e-9
