"""Literal cases of the library's own operators."""

import collections
import json
import math
import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from siltstone.functions import globs, text
from siltstone.operators import catalog, chunking, evaluation, fusion, gating, graph, lexical, repo, vector
from siltstone.plans.channels import Registry as Channels
from siltstone.sources import scripts, tables, writers
from siltstone.sources.registry import Registry
from siltstone.streaming import incremental

PATHS = ["src/main.py", "src/utils.py", "tests/test_main.py", "tests/test_utils.py", "src/app.ts", "src/components/Button.tsx", "docs/README.md", "src/nested/deep/file.py", "lib/legacy.py", "src/config.json", "main.py"]


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame([(i, p) for i, p in enumerate(PATHS)], "id long, uri string")


def picked(df, column):
    return [r.uri for r in df.where(column).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("include", "exclude", "want"),
    [
        (["**/*.py"], [], [p for p in PATHS if p.endswith(".py")]),
        (["src/*.py"], [], ["src/main.py", "src/utils.py", "src/nested/deep/file.py"]),
        (["src/**"], ["**/*.py"], ["src/app.ts", "src/components/Button.tsx", "src/config.json"]),
        (["src/**/file.py"], [], ["src/nested/deep/file.py"]),
        (["*.{ts,tsx}"], [], ["src/app.ts", "src/components/Button.tsx"]),
        (["[lm]*.py"], [], ["lib/legacy.py", "main.py"]),
        ([], ["tests/**"], [p for p in PATHS if not p.startswith("tests/")]),
        (["main.p?"], [], ["main.py"]),
    ],
)
def test_globs(paths, include, exclude, want):
    assert picked(paths, globs.selected(F.col("uri"), include, exclude)) == want


def test_glob_escapes(spark):
    df = spark.createDataFrame([(0, "a_b/100%.py"), (1, "axb/100x.py"), (2, "a\\b")], "id long, uri string")
    assert picked(df, globs.matches(F.col("uri"), "a_b/*")) == ["a_b/100%.py"]
    assert picked(df, globs.matches(F.col("uri"), "*100%*")) == ["a_b/100%.py"]


def test_languages(paths):
    assert picked(paths, globs.of_language(F.col("uri"), ["typescript"])) == ["src/app.ts", "src/components/Button.tsx"]
    assert picked(paths, globs.of_language(F.col("uri"), ["klingon"])) == []
    assert len(picked(paths, globs.of_language(F.col("uri"), []))) == len(PATHS)
    owners = [("docs/", "@docs"), ("*.py", "@py")]
    got = {r.uri: r.o for r in paths.select("uri", globs.owner_of(F.col("uri"), owners).alias("o")).collect()}
    assert got["docs/README.md"] == "@docs" and got["lib/legacy.py"] == "@py" and got["src/app.ts"] is None


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, channel string, doc_id long, score double")


def test_fusion(spark):
    h = fusion.with_ranks(hits(spark, [(1, "coderank", 1, 0.9), (1, "coderank", 2, 0.8), (1, "warp", 2, 0.95)]))
    got = {r.doc_id: r.score for r in fusion.weighted_rrf(h, {"coderank": 1.0, "warp": 2.0}).collect()}
    assert math.isclose(got[1], 1 / 61) and math.isclose(got[2], 1 / 62 + 2 / 61)
    assert {r.doc_id for r in fusion.weighted_rrf(h, {"warp": 0.0}).collect()} == {1, 2}
    assert {r.doc_id for r in fusion.weighted_rrf(h, {"coderank": 0.0}).collect()} == {2}
    assert {r.doc_id: r.channels for r in fusion.rrf(h).collect()}[2] == ["coderank", "warp"]
    x = hits(spark, [(1, "a", 1, 10.0), (1, "a", 2, 11.0), (1, "b", 3, 5.0)])
    n = {r.doc_id: (r.m, r.z) for r in x.select("doc_id", fusion.min_max(F.col("score"), ["channel"]).alias("m"), fusion.z_score(F.col("score"), ["channel"]).alias("z")).collect()}
    assert n == {1: (0.0, -1.0), 2: (1.0, 1.0), 3: (0.0, 0.0)}
    p = {r.doc_id: r.score for r in fusion.pooled(x, {"a": 1.0, "b": 1.0, "absent": 2.0, "bad": -1.0}).collect()}
    assert p == {1: 0.0, 2: 0.25, 3: 0.25}
    assert {r.doc_id for r in fusion.gated(x, "b", 6.0).collect()} == {1, 2}
    ages = spark.createDataFrame([(1, 30.0)], "doc_id long, age_days double")
    s = {r.doc_id: r.score for r in fusion.recency(x, ages, max_boost=0.2).collect()}
    assert math.isclose(s[1], 11.0) and s[2] == 11.0
    r = {r.doc_id: r.position for r in fusion.reordered(h.where("channel = 'coderank'"), h.where("channel = 'warp'")).collect()}
    assert r == {2: 1, 1: 2}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "A a x"), (8, None)], "item_id long, text string")
    got = lexical.bm25(docs, q).collect()
    idf, avgdl = math.log((4 - 1 + 0.5) / 1.5 + 1), 5 / 4
    want = 2 * idf * 2 * 1.9 / (2 + 0.9 * (0.6 + 0.4 * 3 / avgdl))
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(7, 1, 1)] and math.isclose(got[0].score, want, abs_tol=1e-6)
    assert lexical.rm3(docs, q).where("doc_id = 2").count() == 1  # reached by a feedback term


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.99, 0.1])], "doc_id long, v array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q array<float>")
    assert [r.doc_id for r in vector.exact_neighbours(v, q, 2).orderBy("rank").collect()] == [2, 1]
    assert v.select(vector.normalised(F.col("v")).alias("n")).collect()[1].n == [0.0, 0.0]
    c = spark.createDataFrame([(0, 2), (0, 9)], "query_id long, doc_id long")
    got = vector.reranked(c, v, q, 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 9] and got[1].score < -1e38
    assert vector.index_family(100) == ("flat", 0) and vector.index_family(10_000)[1] == 100 and vector.index_family(4_000_000) == ("ivf_pq", 2000)


def test_gates(spark):
    s = spark.createDataFrame([(0, 1.0, 1.0, 0.5), (5, 1.0, 1.0, 0.5), (50, 200.0, 1.0, 0.5), (50, 1.0, 1.0, 0.5), (50, 1.0, 1.0, 0.95)], "candidate_count int, elapsed_ms double, best double, second double")
    assert [r.reason for r in gating.stage_gate(s).collect()] == ["no_candidates", "insufficient_candidates", "upstream_budget_exceeded", "high_margin", "within_budget"]
    q = spark.createDataFrame([(1, "where is the thing that we use now"), (2, "a.b is what we want to see"), (3, ""), (4, "two words")], "id int, t string")
    assert [r.f for r in q.select(gating.wants_feedback(F.col("t")).alias("f")).collect()] == [True, False, False, True]
    p = gating.profile(spark.createDataFrame([(1, ""), (2, "?? !!")], "item_id int, text string")).collect()
    assert p[0].length == 0 and p[0].oov_ratio == 1.0 and p[1].looks_literal
    assert [r[0] for r in spark.createDataFrame([(500, True), (3, False), (0, True)], "n int, f boolean").select(gating.fan_out(F.col("n"), F.col("f"))).collect()] == [400, 3, 2]


def test_intervals(spark):
    a = spark.createDataFrame([(1, "f", 0, 1000), (2, "f", 5, None), (3, "g", 0, 9)], "id int, uri string, s int, e int")
    b = spark.createDataFrame([(10, "f", 990, 2000), (11, "f", 5, 5), (12, "g", 10, 12)], "n int, uri string, x int, y int")
    got = {(r.id, r.n) for r in catalog.overlapping(a, b, "uri", ("s", "e"), ("x", "y"), bucket=16).collect()}
    assert got == {(1, 10), (1, 11), (2, 11)}
    assert catalog.overlapping(a, b, "uri", ("s", "e"), ("x", "y"), bucket=16).count() == 3
    d = spark.createDataFrame([(1, "f", 0, 50), (2, "f", 10, 20), (3, "f", 0, 50), (4, "f", 60, 70)], "id int, uri string, s int, e int")
    assert {r.id for r in catalog.top_level(d, "uri", "id", ("s", "e")).collect()} == {1, 4}


def test_intervals_of_all_lengths(spark):
    rng = random.Random(4)
    make = lambda n: [(i, rng.choice("fg"), s := rng.randint(-50, 4000), s + rng.choice([0, 3, 70, 900, 10**9, -5])) for i in range(n)]
    left, right = make(60) + [(60, "f", None, None), (61, "f", 7, None)], make(70)
    a, b = spark.createDataFrame(left, "id int, uri string, s long, e long"), spark.createDataFrame(right, "n int, uri string, x long, y long")
    span = lambda s, e: (s if s is not None else e, e if e is not None else s)
    want = [(i, n) for i, u, *x in left for n, v, *y in right if u == v and None not in span(*x) and span(*x)[0] <= span(*y)[1] and span(*x)[1] >= span(*y)[0]]
    for bucket in (16, 256):
        got = catalog.overlapping(a, b, "uri", ("s", "e"), ("x", "y"), bucket=bucket)
        assert got.columns == ["uri", "id", "s", "e", "n", "x", "y"]
        assert sorted((r.id, r.n) for r in got.collect()) == sorted(want)
        assert sorted((r.id, r.n) for r in catalog.overlapping(b, a, "uri", ("x", "y"), ("s", "e"), bucket=bucket).collect()) == sorted(want)
    assert catalog.overlapping(a.limit(0), b, "uri", ("s", "e"), ("x", "y")).count() == 0


def test_long_paths_and_rings_take_few_rounds(spark, monkeypatch):
    rounds = []
    spread = graph._spread
    monkeypatch.setattr(graph, "_spread", lambda *a: rounds.append(1) or spread(*a))
    n = 5000
    path = [(i, i + 1) for i in range(1, n)]
    ring = [(n + 1 + i, n + 1 + (i + 1) % 300) for i in range(300)]
    # two hubs joined both ways by chains, and a chain that leaves them
    hubs = [(9000, 9001), (9001, 9002), (9002, 9003), (9003, 9004), (9004, 9005), (9005, 9000), (9003, 9000), (9000, 9010), (9010, 9011), (9000, 8999), (8999, 9000)]
    e = spark.createDataFrame(path + ring + hubs + [(7, 7), (1, 99999)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in sorted({x for p in path + ring + hubs for x in p} | {8888})], "node long")
    got = {r.node: r.component for r in graph.strong_components(e, nodes).collect()}
    want = {i: i for i in [*range(1, n + 1), 8888, 9010, 9011]} | {i: n + 1 for i in range(n + 1, n + 301)} | {i: 8999 for i in range(8999, 9006)}
    assert got == want and len(rounds) < 30


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges, nodes, want, base = [], [], {}, 0
    for size, m in ((6, 7), (12, 14), (12, 30), (20, 22), (20, 26), (3, 3)):
        es = {(rng.randrange(size), rng.randrange(size)) for _ in range(m)}
        reach = {i: {i} for i in range(size)}
        for _ in range(size):
            for a, b in es:
                for i in range(size):
                    if a in reach[i]:
                        reach[i].add(b)
        for i in range(size):
            want[base + i] = base + min(j for j in reach[i] if i in reach[j])
        edges += [(base + a, base + b) for a, b in es]
        nodes += [(base + i,) for i in range(size)]
        base += size
    c = graph.strong_components(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(nodes, "node long"))
    assert sorted((r.node, r.component) for r in c.collect()) == sorted(want.items())


def test_packing_by_line(spark):
    rng = random.Random(8)
    texts = ["\n".join("é" * rng.choice([0, 3, 10, 45]) for _ in range(rng.randint(1, 30))) for _ in range(12)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "uri string, text string")
    spans = df.rdd.map(lambda r: (r.uri, r.text, [(s["start"], s["end"], s["symbol"]) for s in chunking.line_spans(r.text or "")])).toDF("uri string, text string, spans array<struct<start:int,end:int,symbol:string>>")
    got = {(r.uri, r.n): r for r in chunking.pack(df, 20, by_line=True).collect()}
    assert {k: tuple(r) for k, r in got.items()} == {(r.uri, r.n): tuple(r) for r in chunking.pack(spans, 20).collect()} and len(got) > 40
    for (uri, _), r in got.items():
        t = texts[int(uri)]
        assert r.text == t[r.start_char : r.end_char] == t.encode()[r.start_byte : r.end_byte].decode() and len(r.text) <= max(20, 45)
        assert r.start_line == t[: r.start_char].count("\n")


def test_greedy_groups_walk_keys_with_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([0, 1, 5, 9, 30, None])) for i in range(300)]
    got = chunking.greedy_groups(spark.createDataFrame(rows, "k int, pos long, n int").repartition(7), ["k"], "pos", "n", 10)
    assert got.dtypes == [("k", "int"), ("pos", "bigint"), ("chunk", "bigint")]
    want, state = set(), {}
    for k, i, n in rows:
        n = n or 0
        used, g = state.get(k, (0, 0))
        used, g = (used + n, g) if used == 0 or used + n <= 10 else (n, g + 1)
        state[k] = used, g
        want.add((k, i, g))
    assert {tuple(r) for r in got.collect()} == want


def test_hydration_and_repair(spark, paths):
    assert [r.uri for r in catalog.hydrate_list(paths, [2, 0, 2, 99], "id").collect()] == [PATHS[2], PATHS[0], PATHS[2]]
    r = spark.createDataFrame([(0, " "), (1, "kept"), (77, "gone")], "id long, uri string")
    got = {x.id: (x.uri, x.repaired) for x in catalog.repaired(r, paths, ["uri"], "id").collect()}
    assert got == {0: ("src/main.py", True), 1: ("kept", False)}
    up = catalog.latest_rows(paths.limit(2), spark.createDataFrame([(1, "new", 5)], "id long, uri string, more int"), ["id"])
    assert {tuple(x) for x in up.collect()} == {(0, "src/main.py", None), (1, "new", 5)}
    with pytest.raises(ValueError):
        catalog.resolved(paths, "nothing")


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 6)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    c = graph.strong_components(e, n)
    assert {r.node: r.component for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r.component: r.size for r in graph.cycles(c, e).collect()} == {1: 3, 4: 2, 6: 1}
    rank = {i: 1 / 7 for i in range(1, 8)}
    edges = {(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 6)}
    out = {i: sum(a == i for a, _ in edges) for i in rank}
    for _ in range(25):
        rank = {i: 0.15 / 7 + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == i) for i in rank}
    got = {r.node: r["rank"] for r in graph.pagerank(e, n).collect()}
    assert all(math.isclose(got[i], rank[i], rel_tol=1e-9) for i in rank)
    assert {r.node: r.in_cycle for r in graph.summary(e, n, graph.pagerank(e, n, rounds=2), c).collect()}[7] is False


def test_imports(spark):
    i = spark.createDataFrame([("pkg/__init__.py", "pkg.alpha"), ("pkg/alpha.py", "pkg.beta.thing"), ("pkg/alpha.py", "os")], "path string, target string")
    m = spark.createDataFrame([("pkg", "pkg/__init__.py"), ("pkg.alpha", "pkg/alpha.py"), ("pkg.beta", "pkg/beta.py")], "module string, path string")
    assert {tuple(r) for r in graph.resolve_imports(i, m).collect()} == {("pkg/__init__.py", "pkg/alpha.py"), ("pkg/alpha.py", "pkg/beta.py")}
    p = spark.createDataFrame([("src/pkg/mod.py",), ("pkg/sub/__init__.py",), ("a.pyi",)], "p string")
    assert [r.m for r in p.select(text.module_name(F.col("p")).alias("m")).collect()] == ["pkg.mod", "pkg.sub", "a"]
    rel = spark.createDataFrame([("a.b.c", 1, "x"), ("a.b.c", 2, None), ("a", 1, "x"), ("a.b", 0, "q")], "m string, l int, t string")
    assert [r.r for r in rel.select(text.relative_module(F.col("m"), F.col("l"), F.col("t")).alias("r")).collect()] == ["a.b.x", "a", "x", "q"]


def _shuffled(spark):
    """Rows that all stages so far have written to a shuffle."""
    java, gateway = spark.sparkContext._jvm.java.util.ArrayList, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(java(), False, False, gateway.new_array(gateway.jvm.double, 0), java())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_bm25_shuffles_hits_only(spark, monkeypatch):
    """Copies, frequent words, ties, odd texts and ids that are texts, in blocks of queries and few documents at a time."""
    rng = random.Random(8)
    words = ["the", "of", "a", *(f"w{i}" for i in range(30))]
    texts = [" ".join(["the", *rng.choices(words, k=rng.randint(1, 9))]) for _ in range(300)] * 8 + [None, "", "?!", "The the THE"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    asks = [(i, " ".join(["the", *rng.choices(words, k=4)])) for i in range(20)] + [(90, None), (91, "unknown")]
    monkeypatch.setattr(lexical, "QUERIES", 6)
    monkeypatch.setattr(lexical, "CELLS", 2000)
    before = _shuffled(spark)
    got = lexical.bm25(docs, spark.createDataFrame(asks, "item_id int, text string"), 7).collect()
    moved = sum(n for stage, n in _shuffled(spark).items() if stage not in before)
    assert moved < 20_000  # each of 2,400 documents meets each of 20 queries: 48,000 pairs
    toks = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    df = collections.Counter(w for t in toks for w in set(t))
    mean, n = sum(map(len, toks)) / len(toks), len(toks)
    counts = [collections.Counter(t) for t in toks]
    weight = lambda i, w: math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * counts[i][w] * 1.9 / (counts[i][w] + 0.9 * (0.6 + 0.4 * len(toks[i]) / mean))
    want = []
    for q, t in asks:
        scores = [(-round(sum(weight(i, w) for w in (t or "").split() if counts[i][w]), 6), f"d{i}") for i in range(n)]
        want += [(q, d, r + 1, -s) for r, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:7])]
    assert [(r.query_id, r.doc_id, r["rank"]) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [w[:3] for w in want]
    assert all(abs(r.score - w[3]) < 2e-6 for r, w in zip(sorted(got, key=lambda r: (r.query_id, r["rank"])), want, strict=True))
    assert lexical.bm25(docs, spark.createDataFrame([], "item_id int, text string")).count() == 0
    assert lexical.bm25(docs.limit(0), spark.createDataFrame(asks, "item_id int, text string")).count() == 0


def test_words_are_counted_a_text_at_a_time(spark, monkeypatch):
    """What a task holds beside a batch of texts doesn't grow with their words; long texts and patterns with groups count the same."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["The", "OF", "a1", *(f"w{i}" for i in range(200))], k=1000)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kind, caught = type(docs), []
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: caught.append((self, f)) or real(self, f, *a, **b))
    lexical.bm25(docs, spark.createDataFrame([(1, "the of w7")], "item_id int, text string"), 5).collect()
    batches = caught[0][0].toArrow().to_batches()
    tracemalloc.start()
    rows = [r for b in caught[0][1](iter(batches)) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.nbytes for b in batches) + peak < 2 * sum(map(len, texts))
    counts = [collections.Counter(t.lower().split()) for t in texts]
    assert [(r["doc_id"], r["dl"], r["tf"]) for r in rows] == [(i, [1000.0], [float(c[w]) for w in ("of", "the", "w7") if c[w]]) for i, c in enumerate(counts)]
    for pattern in ("[A-Za-z0-9]+", "[A-Za-z](?:[a-z])?", "([A-Za-z])[0-9]+"):
        want = [m[0] for m in re.finditer(pattern, texts[0])]
        assert list(lexical._words(pattern)(texts[0])) == want
        monkeypatch.setattr(lexical, "LONG", 10)
        assert list(lexical._words(pattern)(texts[0])) == want
        monkeypatch.undo()


def test_words_are_split_at_other_bytes(monkeypatch):
    """The words of a class of characters are those of its pattern, of odd, long and broken texts too, without matching."""
    odd = b"It's A_b-9 \xc3\x89t\xc3\xa9 na\xefve\xff\x00nul\x0bVT\xe2\x80\x83EM \xe2\x84\xaa \xc4\xb0x\n[end]"
    for pattern in ("[A-Za-z0-9]+", "[A-Za-z0-9_]+", "[a-z]+", "[A-Z-]+", "[A-Za-z](?:[a-z])?", "([A-Za-z])[0-9]+"):
        for text in (b"", b" ", odd, b"x" * 50 + odd * 20, odd * 3 + b" " * 40):
            want = [m[0].lower().encode() for m in re.finditer(pattern, text.decode(errors="replace"), re.ASCII)]
            for long in (5, 1 << 20):
                monkeypatch.setattr(lexical, "LONG", long)
                assert list(lexical._lowered(pattern)(text)) == want
    monkeypatch.setattr(lexical, "_words", lambda pattern: None)
    assert list(lexical._lowered("[A-Za-z0-9_]+")(b"Of the_w7")) == [b"of", b"the_w7"]


def test_imports_of_one_name(spark):
    rng = random.Random(4)
    modules = [(rng.choice(["a", "a.b", "a.b.c", "ab", "c", None]), rng.choice(["p1", "p2", "p3", "p4", None])) for _ in range(40)]
    imports = [(rng.choice(["p1", "p2", "p9", None]), rng.choice(["a", "a.b.c.d", "a.b.x", "ab.y", "c.z", "d", None])) for _ in range(60)]
    mods, asks = spark.createDataFrame(modules, "module string, path string"), spark.createDataFrame(imports, "path string, target string")
    under = lambda long, short: None not in (long, short) and (long == short or long.startswith(short + "."))
    want, near = set(), set()
    for p, t in imports:
        files = [(len(m), f, f) for m, f in modules if under(t, m) and None not in (p, f) and f != p]
        want |= {(p, max(files)[2])} if files else set()
        near |= {(p, m) for m, _ in modules if under(t, m) or under(m, t)}
    assert sorted(map(tuple, graph.resolve_imports(asks, mods).collect())) == sorted(want)
    assert set(map(tuple, graph.related_tests(asks, mods).collect())) == near and graph.related_tests(asks, mods).count() == len(near)


def test_names_that_many_share(spark):
    """40,000 rows of one name on both sides: 1.6 billion pairs, if rows met one by one."""
    began = time.monotonic()
    mods = spark.range(40_000).select(F.lit("pkg").alias("module"), F.concat(F.lit("p"), "id").alias("path"))
    asks = mods.select("path", F.lit("pkg.x").alias("target"))
    edges = graph.resolve_imports(asks, mods).groupBy("dst_path").count().collect()
    assert {r[0]: r[1] for r in edges} == {"p9999": 39_999, "p9998": 1}
    assert graph.related_tests(asks, mods).count() == 40_000
    rows = spark.range(40_000).select(F.col("id").alias("node_id"), F.col("id").alias("symbol"), F.lit("u").alias("path"), F.lit(1).alias("line"), F.lit("f").alias("name"), F.concat(F.lit("q"), "id").alias("qname"))
    best = repo.stitch(rows.drop("symbol"), rows.drop("node_id"))
    assert best.where("symbol = node_id and confidence = 1").count() == 40_000
    assert time.monotonic() - began < 60


def test_stitch_is_brute_force(spark):
    rng = random.Random(6)
    some = lambda n: [(i, rng.choice(["u", "v", None]), rng.choice([1, 2, 3, 7, None]), rng.choice(["f", "g", None]), rng.choice(["m.f", "m.g", "k", None])) for i in range(n)]
    nodes, found = some(60), some(50)
    nodes += [(0, "v", 2, "g", "m.g")]
    want = {}
    for i, p, line, name, q in nodes:
        for s, cp, cl, cn, cq in found:
            close, same = None not in (line, cl) and abs(line - cl) <= 1, name is not None and name == cn
            if p is not None and p == cp and (close or same):
                score = 1.0 if q is not None and q == cq else 0.8 if close and same else 0.6 if same else 0.5
                want[i] = min(want.get(i, (0, 0)), (-score, s))
    cols = "path string, line int, name string, qname string"
    out = repo.stitch(spark.createDataFrame(nodes, f"node_id long, {cols}"), spark.createDataFrame(found, f"symbol long, {cols}"))
    assert {r.node_id: (-r.confidence, r.symbol) for r in out.collect()} == want and out.count() == len(want)


def test_tags_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Eight discounts of 0.065 on average, in orders in which doubles add up to less, and to more."""
    from siltstone.plans import graph_queries

    cols = "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_tax double, l_discount double"
    rows = [(11, 1, 1, 1, "R", "F", 0.0, d) for d in [0.03, 0.06, 0.07, 0.08, 0.09, 0.04, 0.06, 0.09]] + [(13, 1, 1, 1, "R", "F", 0.0, d) for d in [0.09, 0.09, 0.08, 0.07, 0.06, 0.06, 0.04, 0.03]]
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: r.tags for r in graph_queries.tag_rules(spark, str(tmp_path)).collect()}
    assert got == {11: "docs-missing", 13: "docs-missing"}


def test_tags_of_odd_discounts(spark, tmp_path):
    """Discounts that are no decimal of 12 places give what SQL's doubles give: nothing is rounded, and nothing fails."""
    import duckdb

    from siltstone.plans import graph_queries
    from siltstone.plans.catalogue import oracle_sql

    cols = "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_tax double, l_discount double"
    found = [0.0649999999999996, 0.0650000000000004, float("nan"), float("inf"), float("-inf"), 1e7, -1e300, None, 0.06]
    rows = [(5 * i + 1, 1, 1, 1, "R", "F", 0.0, d) for i, d in enumerate(found)] + [(1, 1, 1, 1, "R", "F", 0.0, None)]
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("tag_rules", "hotspot_score"):
        got = {tuple(r) for r in getattr(graph_queries, name)(spark, str(tmp_path)).collect()}
        assert got == set(con.execute(oracle_sql()[name]).fetchall()) and len(got) == len(found)


def test_python_modules(spark):
    code = 'import os\nfrom .x import *\n__all__ = ["f"]\n\ndef f(a: int, b) -> int:\n    """Doc."""\n    if a:\n        raise KeyError(b)\n    return a\n'
    rows = {r.path: r for r in repo.modules(spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None)], "path string, code string")).collect()}
    a = rows["a.py"]
    assert (a.cyclomatic, a.cognitive, a.n_functions, a.param_ratio, a.return_ratio, a.doc_ratio, a.exports, a.raises) == (2, 3, 1, 0.5, 1.0, 1.0, ["f"], ["KeyError"])
    assert [(x.module, x.name, x.level) for x in a.imports] == [("os", "", 0), ("x", "*", 1)]
    assert rows["b.py"].error == "SyntaxError" and rows["c.py"].error is None
    h = spark.range(1).select(repo.hotspot(*[F.lit(x) for x in (0, 0, 0, 0, 0, 0)], F.lit(None).cast("double")).alias("h")).first().h
    assert h == round(0.2 * math.log(2) + 0.3 * math.log(2) + 0.2, 3)


def test_chunks(spark):
    t = "é" * 10 + "\n\n" + "x" * 30
    spans = [{"start": 0, "end": 5, "symbol": "a"}, {"start": 5, "end": 10, "symbol": "b"}, {"start": 12, "end": 42, "symbol": "c"}]
    df = spark.createDataFrame([("u", t, spans), ("v", None, None)], "uri string, text string, spans array<struct<start:int,end:int,symbol:string>>")
    got = [(r.start_char, r.end_char, r.start_byte, r.end_byte, r.symbols) for r in chunking.pack(df, 20).orderBy("n").collect()]
    assert got == [(0, 10, 0, 20, ["a", "b"]), (12, 32, 22, 42, ["c"]), (32, 42, 42, 52, ["c"])]
    assert chunking.split_large("ab\n\ncdef", 0, 8, 6) == [(0, 6), (6, 8)] or chunking.split_large("ab\n\ncdef", 0, 8, 6) == [(0, 3), (3, 8)]
    g = spark.createDataFrame([("k", i, 4) for i in range(5)], "k string, pos long, n long")
    assert [r.chunk for r in chunking.greedy_groups(g, ["k"], "pos", "n", 8).orderBy("pos").collect()] == [0, 0, 1, 1, 2]


def test_evaluation(spark):
    h = spark.createDataFrame([(1, 101, 1), (1, 202, 2), (2, 5, 1)], "query_id long, doc_id long, rank long")
    good = spark.createDataFrame([(1, 202), (1, 303), (2, 9)], "query_id long, doc_id long")
    m = evaluation.means(evaluation.per_query(h, good, 5)).first()
    assert (m.n_queries, m.recall, m.hit_rate, m.mrr) == (2, 0.25, 0.5, 0.25)
    sweep = spark.createDataFrame([("slow", 0.90, 9.0), ("fast", 0.896, 3.0), ("poor", 0.5, 1.0)], "name string, recall double, latency double")
    assert evaluation.select_candidate(sweep).first().name == "fast"


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\n•  b\x01c", "12", "[3] then [1, 2, 2] end")], "t string, n string, a string")
    r = df.select(text.canonical(F.col("t")).alias("c"), text.as_int(F.col("n")).alias("n"), text.as_int(F.col("t")).alias("z"), text.ranking_ids(F.lit("say [1, 2, 2] end")).alias("ids"), text.truncated(F.lit("ab\ncdefgh"), F.lit(1)).alias("cut"), text.symbol_name(F.lit("scip python pkg 1 `a.b`/Klass#run().")).alias("s"), text.quantised_query(F.lit(0.025)).alias("q"), text.quantised_document(F.lit(0.025)).alias("d")).first()
    assert (r.c, r.n, r.z, r.ids, r.cut, r.s, r.q, r.d) == ("a - b c", 12, 0, [1, 2], "ab\n…", "run", 2, 3)
    ids = spark.createDataFrame([("x",)], "t string").select(text.content_hash("t").alias("h"), text.doc_urn("t").alias("u")).first()
    import xxhash

    assert ids.h % (1 << 64) == xxhash.xxh64_intdigest(b"x") and ids.u.startswith("urn:doc:sha256:")


def test_sources(spark, tmp_path):
    assert tables.scan_parquet(spark, str(tmp_path / "none"), schema=tables.CHUNKS).count() == 0
    assert tables.optional_view(spark, "nothing", str(tmp_path / "none")) is False
    scip = {"documents": [{"relativePath": "a.py", "language": "python", "occurrences": [{"symbol": "s", "range": [1, 2, 5], "roles": 1}, {"symbol": "t", "range": [1, 2, 3, 4]}, {"symbol": "bad", "range": [1]}]}]}
    (tmp_path / "i.json").write_text(json.dumps(scip))
    got = [(r.symbol, r.start_line, r.end_line, r.end_col, r.roles) for r in tables.read_scip(spark, str(tmp_path / "i.json")).orderBy("occ_order").collect()]
    assert got == [("s", 1, 1, 5, 1), ("t", 1, 3, 4, 0)]
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="1"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert [(r.path, r.covered) for r in tables.read_cobertura(spark, str(tmp_path / "c.xml")).collect()] == [("a.py", 0.5)]
    (tmp_path / "q.jsonl").write_text('{"id": "1"}\nnot json\n{"id": "2"}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "q.jsonl"), "id string", skip_bad=True).count() == 2
    assert tables.read_jsonl(spark, str(tmp_path / "q.jsonl"), "id string").select("id", "_corrupt").collect()[1]._corrupt == "not json"
    (tmp_path / "qrels").write_text("q1 0 d1 1\nq1 0 d2 0\n")
    assert [tuple(r) for r in tables.read_qrels(spark, str(tmp_path / "qrels")).collect()] == [("q1", "d1", 1), ("q1", "d2", 0)]
    conf = spark.createDataFrame([("a.yaml", "x:\n  y: 1\nz: 2\n"), ("b.toml", "[t]\n[t.u]\n"), ("c.md", "# One\n## Two\n")], "path string, value string")
    assert {tuple(r) for r in tables.config_keys(conf).collect()} == {("a.yaml", "x"), ("a.yaml", "z"), ("b.toml", "t"), ("b.toml", "t.u"), ("c.md", "One"), ("c.md", "Two")}
    keys = tables.json_keys(spark.createDataFrame([(1, '{"a": {"b": 1}, "c": 2}')], "i int, j string"), "i", "j")
    assert {r.key for r in keys.collect()} == {"a", "a.b", "c"}
    deep = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":1}}},"l":[{"x":1},[2,[{"y":[]}]]]}'), (2, "[[7]]"), (3, "no json"), (4, None), (5, "3"), (None, '{"k":null}'), (1, '{"a":0}')], "i int, j string")
    want = [(1, k) for k in ("a", "a.b", "a.b.c", "a.b.c.d", "l", "l[0]", "l[0].x", "l[1]", "l[1][0]", "l[1][1]", "l[1][1][0]", "l[1][1][0].y", "a")] + [(2, "[0]"), (2, "[0][0]"), (None, "k")]
    assert sorted(map(str, map(tuple, tables.json_keys(deep, "i", "j").collect()))) == sorted(map(str, want))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, k string, v string")
    writers.write_partitioned(df, str(tmp_path / "p"), ["k"])
    writers.write_partitioned(spark.createDataFrame([(3, "b", "z")], df.schema), str(tmp_path / "p"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("id", "k").collect()} == {(1, "a"), (3, "b")}
    writers.write_jsonl(df, str(tmp_path / "j"))
    lines = sorted(line for f in (tmp_path / "j").glob("part*") for line in f.read_text().splitlines())
    assert lines[0] == '{"id":1,"k":"a","v":"x"}'
    df.write.parquet(str(tmp_path / "u"))
    new = writers.upsert(spark, str(tmp_path / "u"), spark.createDataFrame([(2, "B", "new")], df.schema), ["id"])
    assert {tuple(r) for r in spark.read.parquet(new).collect()} == {(1, "a", "x"), (2, "B", "new")}
    assert writers.refresh_if_changed(spark, df, str(tmp_path / "m"), "s1") and not writers.refresh_if_changed(spark, df, str(tmp_path / "m"), "s1")
    v = writers.Versions(spark, str(tmp_path / "idx"))
    assert v.current() is None
    v.publish(df, "v1")
    v.publish(df.limit(1), "v2", note="less")
    assert v.current() == "v2" and v.rollback() == "v1" and v.read().count() == 2
    a = writers.content_checksum(df, "id", "v").first()
    assert a == writers.content_checksum(df.orderBy(F.desc("id")), "id", "v").first()
    with pytest.raises(ValueError):
        writers.validated(df, tables.CHUNKS)


def test_incremental_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, i) for i in range(40)]
    src = str(tmp_path / "src")
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "k long, v long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(src)
    q = incremental.start_incremental(stream, str(tmp_path / "out"), "k", str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 7 and {r.k for r in got.collect()} == set(range(7))
    assert not incremental.compact_due(100, 5) and incremental.compact_due(100, 6) and incremental.compact_due(0, 1)


def test_windowed_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(s, late="1 minute").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("win").collect())) == sorted(map(key, incremental.windowed_counts(e).collect()))


def test_channels(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    hit = lambda doc: lambda queries, sources: queries.select("query_id", F.lit(doc).alias("doc_id"), F.lit(1).alias("score"))
    c = Channels()
    c.add("bm25", hit(1), ("documents",))
    c.add("dense", hit(2), ("embeddings",))
    c.add("off", hit(3))
    hits, skipped = c.gather(q, {"documents": q}, {"bm25": 5, "dense": 5, "off": 5}, ("off",))
    assert [(r.channel, r.doc_id, r["rank"]) for r in hits.collect()] == [("bm25", 1, 1)]
    assert skipped == ["dense: needs embeddings", "off: disabled"]
    with pytest.raises(ValueError):
        c.add("bm25", hit(1))


def test_scripts(spark):
    script = "-- a; comment\nSELECT ';' AS a, 1 - 1 AS b; /* x; */ SELECT :n AS c;"
    assert scripts.statements(script) == ["SELECT ';' AS a, 1 - 1 AS b", "SELECT :n AS c"]
    assert scripts.run_script(spark, "SELECT :n AS c", n=3)[0].first().c == 3


def test_registry(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "log"))
    r.record("dataset", "d1", "begun", "/data/d1")
    with pytest.raises(ValueError):
        r.record("dataset", "d1", "begun")
    r.record("dataset", "d1", "committed")
    r.record("dataset", "d2", "begun", "/data/d2")
    assert [(x.key, x.root) for x in r.committed("dataset").collect()] == [("d1", "/data/d1")]


def test_json_objects_and_nodes(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{\n "a": 1\n}\n{"a":\n2}\n{"a": ')
    assert [r.a for r in tables.json_objects(spark, str(tmp_path / "m.jsonl"), "a long").collect()] == [1, 2]
    code = "class A(B):\n    @property\n    def _x(self):\n        def inner(): pass\n"
    got = [(r.kind, r.qualname, r.parent, r.is_public, r.decorators, r.bases) for r in repo.syntax_nodes(spark.createDataFrame([("a.py", code), ("b.py", "(")], "path string, code string")).orderBy("line").collect()]
    assert got == [("ClassDef", "A", None, True, [], ["B"]), ("FunctionDef", "A._x", "A", False, ["property"], []), ("FunctionDef", "A._x.inner", "A._x", True, [], [])]


def test_filters_and_exports(spark):
    rows = spark.createDataFrame([(1, "src/a.py", ["s"]), (2, "src/b.ts", ["t"]), (3, "c.py", None)], "id long, uri string, symbols array<string>")
    ids = lambda **k: sorted(r.id for r in catalog.filtered(rows, **k).collect())
    assert ids() == [1, 2, 3] and ids(ids=[]) == [] and ids(include=["src/*"], languages=["python"]) == [1] and ids(symbols=["t", "z"]) == [2]
    n = spark.createDataFrame([("p", "f", "f"), ("p", "g", "f.g"), ("p", "h", "h"), ("q", "f", "f")], "path string, name string, qualname string")
    assert sorted(r.qualname for r in catalog.exported(n, spark.createDataFrame([("p", "f")], "path string, exported string")).collect()) == ["f", "f.g"]
    calls = spark.createDataFrame([(1, "f", 3), (1, "g", 1), (1, "f", 9), (2, "nope", 1)], "chunk_id long, name string, pos long")
    defs = spark.createDataFrame([("f", "def f()"), ("g", "def g()")], "name string, signature string")
    assert [r.context for r in chunking.related(calls, defs).collect()] == ["def g()\ndef f()"]
