"""The pipeline over the smallest tables: every stage's result by its own brute-force rule."""

import os

import pytest

import corpus_pipeline
from codefacts.llm import packing
from codefacts.llm.common import durable
from tests.llm.test_text_operators import brute_components, brute_repeated

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(durable(stage(spark, kept[-1], SF), name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5] and len(ids[4]) > 50
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in ids[0] - ids[1]) <= 2  # clean documents stay
    wrong = {r["doc_id"] for r in kept[1].collect() if not (r["text"] or "").strip()}
    assert len(ids[1] - ids[2] - wrong) <= 2

    before = [(r["doc_id"], r["text"]) for r in kept[2].select("doc_id", "text").collect()]
    assert ids[3] == {c for _, _, c in brute_components(before)}
    rows = [(r["doc_id"], r["text"]) for r in kept[3].select("doc_id", "text").collect()]
    repeated, left = brute_repeated(rows), dict(kept[4].select("doc_id", "text").collect())
    for i, text in rows:
        words = (text or "").split()
        gone = len(words) - len((left.get(i) or "").split())
        assert gone == len(repeated[i])
    tokens = sum(len(packing.token_ids(t)) for t in left.values())
    assert tokens == sum(r["length"] for r in kept[5].collect())


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "jaccard_join", "suffix_dedup", "packing"]
