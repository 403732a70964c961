"""Inverted lists against exact search: recall, filters that widen, quantised codes, the recall curve, token search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import lists, vector
from siltstone.plans import ann_queries, retrieval


def ranks(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    return {q: [d[k] for k in sorted(d)] for q, d in out.items()}


def recall(found, truth):
    a = {q: {i for i, _ in rows} for q, rows in found.items()}
    return sum(len(a.get(q, set()) & {i for i, _ in rows}) for q, rows in truth.items()) / sum(map(len, truth.values()))


@pytest.fixture(scope="module")
def data(spark):
    v, q = retrieval._vectors(spark, "/root/testdata/sf0.1")
    v, q = v.cache(), q.cache()
    ivf = lists.Ivf.fit(v)
    return v, q, ivf, ivf.index(v), ranks(vector.exact_neighbours(v, q, 20))


def test_recall_is_at_least_nine_tenths(data):
    v, q, ivf, index, truth = data
    assert index.count() == v.count() and len(ivf.centroids) == 44
    found = ranks(ivf.search(index, q, 20))
    assert recall(found, truth) >= 0.9
    assert ranks(ivf.search(index, q, 20, probes=len(ivf.centroids))) == truth


def test_every_vector_asks_for_recall(spark, tmp_path, monkeypatch):
    """Brute force on ids of which 20 divides none, and again with small blocks."""
    rng = np.random.default_rng(5)
    rows = [(20 * i + 1 + i % 3, [float(x) for x in rng.integers(-2, 3, 4)], int(i % 7 if i else 99)) for i in range(70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    recalls, ranked = [], []
    for a, q, label in rows:
        best = sorted((-float(np.dot(q, v)), b, other) for b, v, other in rows if b != a)[:10]
        good = [rank for rank, (_, _, other) in enumerate(best, 1) if other == label]
        size = sum(other == label for b, _, other in rows if b != a)
        if size:
            recalls.append(len(good) / size)
            ranked.append(1 / good[0] if good else 0.0)
    want = (69, *(round(float(np.mean(x)), 6) for x in (recalls, [r > 0 for r in ranked], ranked)))
    assert tuple(retrieval.recall_mrr_at_k(spark, str(tmp_path)).first()) == pytest.approx(want, abs=1e-6)
    monkeypatch.setattr(vector, "VECTORS", 30)
    monkeypatch.setattr(vector, "QUERIES", 8)
    assert tuple(retrieval.recall_mrr_at_k(spark, str(tmp_path)).first()) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("tile", [(256, 4096), (7, 64), (3, 5)])
def test_tiles_keep_the_best(monkeypatch, tile):
    """Ties, copies, repeated ids and fewer vectors than asked for, against sorting all scores."""
    monkeypatch.setattr(vector, "TILE", tile)
    rng = np.random.default_rng(6)
    for n, k, size in ((300, 10, 3), (300, 1, 2000), (8, 10, 2), (1, 3, 1)):
        ids, x = rng.permutation(n) % 290, rng.integers(-size, size + 1, (n, 4)).astype("float32") / np.float32(7)
        got = vector._nearest(pd.DataFrame({"doc_id": ids, "v": list(x)}), pd.DataFrame({"query_id": np.arange(20), "q": list(x[np.arange(20) % n])}), k)
        for i in range(20):
            scores = np.round(x.astype(float) @ x[i % n].astype(float), 6)
            want = sorted((-s, d) for s, d in zip(scores, ids, strict=True) if d != i)[:k]
            mine = got[got["query_id"] == i]
            assert [d for _, d in want] == list(mine["doc_id"]) and np.allclose([-s for s, _ in want], mine["score"], atol=1e-9)


def test_pieces_and_blocks_change_nothing(data, monkeypatch):
    _, q, ivf, index, _ = data
    want = ranks(ivf.search(index, q, 7, probes=9))
    monkeypatch.setattr(lists, "VECTORS", 50)
    monkeypatch.setattr(lists, "QUERIES", 30)
    assert ranks(ivf.search(index, q, 7, probes=9)) == want


def test_shards_are_bounded():
    sizes = {c: n for c, n in enumerate([10, 70_000, 5, 32_768, 1, 32_767])}
    assert lists._shards(sizes) == [(0, 0, 1), (1, 1, 3), (2, 4, 1), (3, 5, 1), (4, 6, 1), (5, 6, 1)]


def test_filtered_search_widens_until_it_has_enough(data):
    v, q, ivf, index, _ = data
    x = {r.doc_id: np.array(r.v) for r in v.collect()}
    asked = [r.query_id for r in q.collect()]
    for share, probes in ((0.3, None), (0.3, 1), (0.006, 1)):
        allowed = v.where(F.rand(5) < share).select("doc_id").cache()
        ids = sorted(r.doc_id for r in allowed.collect())
        truth = {a: [(i, s) for s, i in sorted(((round(float(x[a] @ x[i]), 6), i) for i in ids if i != a), key=lambda t: (-t[0], t[1]))[:10]] for a in asked}
        rows = lists.filtered_search(ivf, index, q, allowed.unionAll(allowed).unionAll(allowed.limit(1).select(F.lit(None))), 10, probes=probes)
        found = ranks(rows)
        assert all(len(found[a]) == min(10, len(truth[a])) for a in asked)
        assert all(i in ids for hits in found.values() for i, _ in hits)
        if probes is None:
            assert recall(found, truth) >= 0.9
        reach = {r.query_id: (r.n_lists, r.n_read) for r in rows.collect()}
        assert all(r >= min(21, len(ids)) and (n == 1 or n <= 44) for n, r in reach.values())
        if share < 0.1:
            assert recall(found, truth) == 1.0 and min(n for n, _ in reach.values()) > 1
    assert lists.filtered_search(ivf, index, q, v.limit(0).select("doc_id"), 10).count() == 0


def test_quantised_search_refines_to_nine_tenths(data):
    v, q, ivf, index, truth = data
    pq = lists.Pq.fit(ivf, v)
    coded = pq.encode(index)
    assert {len(r.code) for r in coded.collect()} == {16}
    rows = coded.join(v, "doc_id").collect()
    cells, codes = np.array([r.cell for r in rows]), np.array([np.frombuffer(r.code, np.uint8) for r in rows])
    x = np.array([r.v for r in rows])
    near = pq.decoded(cells, codes)
    assert ((near - x) ** 2).sum() < 0.5 * ((ivf.centroids[cells] - x) ** 2).sum()
    # every code is the nearest of its book
    rest = (x - ivf.centroids[cells]).reshape(len(x), 16, -1)
    for i in range(0, len(x), 97):
        for j, book in enumerate(pq.books):
            assert codes[i, j] == ((book - rest[i, j]) ** 2).sum(1).argmin()
    # the table of products gives the product with the decoded vector
    got = ranks(pq.search(coded, q, 5, probes=44))
    ids, asked = np.array([r.doc_id for r in rows]), {r.query_id: np.array(r.q) for r in q.collect()}
    for a in list(asked)[:20]:
        s = np.where(ids == a, -np.inf, near @ asked[a])
        assert np.allclose(sorted(s)[-5:][::-1], [score for _, score in got[a]], atol=2e-6)
    refined = pq.refined(coded, v, q, 20)
    assert recall(ranks(refined), truth) >= 0.9
    curve = {r.factor: r.recall for r in lists.factor_curve(pq.search(coded, q, 200, 44), vector.exact_neighbours(v, q, 20), 20, [1, 2, 5, 10]).collect()}
    assert curve[1] < curve[2] < curve[5] <= curve[10] and curve[10] > 0.97
    with pytest.raises(ValueError):
        lists.Pq.fit(ivf, v, parts=7)


def test_recall_curve_is_the_recall_of_each_search(spark, data):
    v, q, ivf, index, truth = data
    exact = vector.exact_neighbours(v, q, 20)
    curve = {r.probes: r for r in lists.recall_curve(lists.placed(ivf, index, q), index, exact).collect()}
    assert set(curve) == set(range(1, 45)) and curve[44].recall == 1.0 and curve[44].mean_read == v.count()
    for probes in (1, 7, 30):
        assert abs(curve[probes].recall - recall(ranks(ivf.search(index, q, 20, probes)), truth)) < 1e-12


def test_token_search_finds_what_max_sim_finds(spark):
    tokens, asked = ann_queries._tokens(spark, "/root/testdata/sf0.1")
    every = vector.max_sim(asked.select("query_id", F.col("token").alias("qt"), "q"), tokens.select("doc_id", F.col("token").alias("dt"), "v"), 10)
    truth = ranks(every)
    got = ranks(ann_queries.token_search(spark, "/root/testdata/sf0.1"))
    assert recall(got, truth) >= 0.9
    given = every.select("query_id", "doc_id")
    again = lists.token_rescored(given.unionAll(given), asked, tokens, 10, explain=2)
    assert {a: [i for i, _ in r] for a, r in ranks(again).items()} == {a: [i for i, _ in r] for a, r in truth.items()}
    row = again.first()
    assert len(row.matches) == 2 and row.matches[0].similarity >= row.matches[1].similarity
    assert lists.token_rescored(given.limit(0), asked, tokens, 10).count() == 0


def test_nothing_to_search(spark):
    v = spark.createDataFrame([], "doc_id long, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, q array<float>")
    ivf = lists.Ivf.fit(v)
    assert ivf.search(ivf.index(v), q, 3).count() == 0
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [0.5, 0.0])], "doc_id long, v array<float>")
    ivf = lists.Ivf.fit(some)
    assert ranks(ivf.search(ivf.index(some), q, 3, probes=5)) == {1: [(4, 0.5)]}


def test_lists_are_found_some_rows_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(2)
    ivf, x = lists.Ivf(rng.normal(size=(1024, 16))), rng.normal(size=(10_000, 16))
    tracemalloc.start()
    near = ivf.nearest(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (near[:200] == ivf.order(x[:200])[:, 0]).all() and len(near) == len(x)
    assert peak < 20 << 20  # distances of all rows to all lists: 82 MB, and as much for their order
