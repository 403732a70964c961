"""The pipeline, stage by stage, and run() against its brute-force version."""

import hashlib

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from siltstone.llm import mixing
from tests.llm.test_operators import brute_classes, brute_hits, brute_substrings


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf).cache())
    return out


def test_stages_chain(spark, sf, stages):
    docs = stages[0]
    for s in stages[1:-1]:
        assert s.dtypes == docs.dtypes
    bench = pq.read_table(f"{sf}/benchmark.parquet").to_pandas()
    known, first, cut, clean, mixed = ([(r.doc_id, r.text) for r in s.collect()] for s in stages[1:])
    assert len(known) > 0.95 * docs.count()
    assert {i for i, _ in first} == {i for i, (_, c) in brute_classes(known, corpus_pipeline.NEAR).items() if i == c}
    kept = {i: (n - gone, sha) for i, n, gone, _, sha in brute_substrings(first)}
    for i, t in cut:
        if kept[i][1] != hashlib.sha256(t.encode()).hexdigest():
            assert abs(len(t.encode()) - kept[i][0]) < 8  # a cut through a character drops its other bytes
    assert {i for i, _ in first} - {i for i, _ in cut} <= {i for i, _ in first if kept[i][0] < 60}
    hits = brute_hits(cut, list(zip(bench.item_id, bench.text)))
    assert {i for i, _ in clean} == {i for i, _ in cut if not hits[i][1]}
    p = {r.doc_id: r.p for r in mixing.weigh(stages[4]).collect()}
    assert {i for i, _ in mixed} == {i for i, _ in clean if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < p[i]}


def test_run(spark, sf, stages):
    got = {(r.doc_id, r.text) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {(r.doc_id, r.text) for r in stages[-1].collect()}


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
        assert docs.count() == 0
