"""The pipeline stage by stage against brute force, and the rules of its stages."""

import random

import corpus_pipeline as P
from helpers import awkward_rows, documents, sentence, shingles

from examlytics.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at = docs
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, at, SF)
        seen[name] = (at.collect(), out.collect())
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert {tuple(r) for r in seen[name][1]} <= {tuple(r) for r in seen[name][0]}
            at = spark.createDataFrame(seen[name][1], docs.schema)
    before, after = seen["toxicity"]
    score = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not score[r.doc_id]}
    before, after = seen["near_duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    kept = {r.doc_id for r in after}
    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(linked(a, b) for a in kept for b in kept if a < b)
    assert all(any(linked(a, b) for b in sets if b != a) for a in set(sets) - kept)
    items = [r.text.strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = seen["decontamination"]
    leaky = {r.doc_id for r in before if any(t in (r.text or "") for t in items)}
    assert not leaky & {r.doc_id for r in after}
    before, after = seen["sharding"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert {(r.doc_id, r.shard) for r in P.run(spark, SF).collect()} == {(r.doc_id, r.shard) for r in after}


def test_stages_take_awkward_rows_and_none(spark):
    rows = awkward_rows(random.Random(1)) + [(60 + k, sentence(random.Random(k), 80)) for k in range(5)]
    docs = documents(spark, rows)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count()
        assert stage(spark, docs.where("n_chars = 77"), SF).collect() == []
        if name in ("toxicity", "decontamination"):
            assert out.count() == docs.count()
