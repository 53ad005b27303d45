"""The pipeline, stage by stage, against brute force on its own input."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from marquee.llm import pii  # noqa: E402
from marquee.session import scratch_path  # noqa: E402

from .test_operators import SMALL, brute_components  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "t-pipeline")
        stage(spark, docs[-1], SMALL).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_columns_of_documents_stay(steps):
    assert all(d.columns == steps[0].columns for d in steps[:5])


def test_quality_drops_junk_and_keeps_good(spark, steps):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r.doc_id for r in steps[1].collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in steps[0].collect()}
    assert len(good & kept) >= 0.97 * len(good) and len(kept) < steps[0].count()


def test_exact_dedup_keeps_the_largest_id(steps):
    best = {}
    for r in steps[1].collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in steps[2].collect()} == set(best.values())


def test_near_dedup_keeps_one_of_each_group(steps):
    comps = brute_components([(r.doc_id, r.text) for r in steps[2].collect()])
    assert {r.doc_id for r in steps[3].collect()} == {i for i, c in comps.items() if c[2]}


def test_pii_is_masked_and_the_rest_stays(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    for r in steps[4].collect():
        assert not pii.base_spans(r.text)[0] and r.n_chars == len(r.text)
        if not any(c.isdigit() or c == "@" for c in before[r.doc_id].text):
            assert r.text == before[r.doc_id].text


def test_packing_holds_every_document(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in steps[4].collect()}
    assert all(r.offset + r.length <= 4096 for r in rows)


def test_empty_input(spark, steps):
    docs = steps[0].where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
