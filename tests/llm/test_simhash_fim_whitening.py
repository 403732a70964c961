"""SimHash, fill-in-the-middle and whitening against brute-force versions, on odd rows as on plain ones."""

import collections
import functools
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from siltstone.llm import fim, queries, simhash, whitening
from siltstone.llm.oracles import SQL
from tests.llm.test_operators import DOCS, odd_texts, rows_of

# --- SimHash


@functools.lru_cache(None)
def brute_print(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] if len(found) >= words else [" ".join(found)] if found else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_linked(rows, radius=2):
    """Fingerprint and component of each row (id, text)."""
    prints = [brute_print(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if (prints[a] ^ prints[b]).bit_count() <= radius or i == j:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return [(i, f"{f:016x}", root(i)) for (i, _), f in zip(rows, prints, strict=True)]


def similar_texts(n=150):
    """Long texts with few changes, so that fingerprints lie 0 to 6 bits apart, in chains too."""
    rng, out = random.Random(9), []
    for g in range(6):
        words = [rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 999)) for _ in range(400)]
        for k in range(n // 6):
            words = words.copy()
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
            out.append((10_000 - 100 * g - k, " ".join(words)))
    return out


@pytest.mark.parametrize(("segments", "tile", "visitors"), [(4, 16_384, 131_072), (4, 3, 5), (8, 2, 2), (2, 7, 9), (1, 5, 64), (16, 4, 3)])
def test_simhash(spark, segments, tile, visitors, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    monkeypatch.setattr(simhash, "SLICE", 40 if tile == 3 else 1 << 20)
    texts = [t for t in odd_texts() if t[0] != -1] + similar_texts()
    docs = spark.createDataFrame(rows_of([*texts, (-1, texts[0][1])]), DOCS).repartition(3)
    got = simhash.classes(docs, segments=segments).select("doc_id", simhash.hexadecimal(simhash.F.col("fp")), "component_id")
    want = brute_linked(texts)
    sizes = collections.Counter(c for _, _, c in want)
    assert len(sizes) > 20 and max(sizes.values()) > 8
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter([*want, (None, "0" * 16, None)])


def test_simhash_of_strings_and_of_nothing(spark):
    texts = similar_texts(30)
    docs = spark.createDataFrame([(f"n{i:06}", t, 1) for i, t in texts], "doc_id string, text string, fp int")
    got = {r.doc_id: r.component_id for r in simhash.classes(docs).collect()}
    assert got == {f"n{i:06}": f"n{c:06}" for i, _, c in brute_linked(texts)}
    assert simhash.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_that_repeat_an_id_link_their_texts(spark):
    texts = [(5, "one text of some words"), (7, "another text altogether with words"), (7, "one text of some words"), (9, "another text altogether with words"), (8, "a third one that is by itself here")]
    got = simhash.classes(spark.createDataFrame(rows_of(texts), DOCS)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (7, 5), (7, 5), (8, 8), (9, 5)]


def test_long_texts_have_the_fingerprint_of_the_whole(monkeypatch):
    text = " ".join(f"w{i % 977}\tX" for i in range(50_000))
    want = simhash.fingerprint(text)
    for slice_, many in ((1 << 10, 7), (1 << 24, 1 << 24)):
        monkeypatch.setattr(simhash, "SLICE", slice_)
        monkeypatch.setattr(simhash, "SHINGLES", many)
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("A  b\nC d") == brute_print("a b c d") and simhash.fingerprint(" \t") == 0


def test_dense_tiles_give_stars(monkeypatch):
    """Very many fingerprints within the radius give a link a fingerprint, not one a pair."""
    monkeypatch.setattr(simhash, "ROWS", 16)
    monkeypatch.setattr(simhash, "COLUMNS", 32)
    fp = np.array([1 << i for i in range(60)] + [0xFFFF << 40], np.uint64)
    tile = simhash._Tile(2)
    home = np.arange(61) < 30
    tile.add(fp[:20], np.arange(20) + 100, home[:20])
    tile.add(fp[20:], np.arange(20, 61) + 100, home[20:])
    a, b = tile.edges()
    assert set(a) == {100} and sorted(b) == list(range(101, 160))


# --- fill in the middle


def brute_cut(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_the_middle(spark):
    texts = odd_texts() + [(200, "a <P> b"), (201, "x<M>"), (202, "<S>"), (203, "<" * 30 + ">"), (204, "😀é\r\n\0  end"), (205, "z" * 300_000)] + [(300 + i, f"text number {i} é") for i in range(200)]
    docs = spark.createDataFrame(rows_of(texts), DOCS).repartition(3)
    got = fim.transform(docs)
    want = [brute_cut(None if i == -1 else i, t) for i, t in texts]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert collections.Counter(w[2] for w in want).keys() == {"plain", "psm", "spm"}
    back = got.select("doc_id", fim.restore(simhash.F.col("output"), simhash.F.col("form")))
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((None if i == -1 else i, t or "") for i, t in texts)
    assert fim.transform(spark.createDataFrame([], DOCS)).count() == 0


def test_units_and_sentinels_are_parameters(spark):
    docs = spark.createDataFrame([(i, f" one  two three{i}\nfour ") for i in range(80)], "n long, output string")
    got = fim.transform(docs, id_col="n", text_col="output", units=r"\S+\s*", rate=100, sentinels=("(pre)", "(suf)", "(mid)"))
    rows = got.select("*", fim.restore(simhash.F.col("output"), simhash.F.col("form"), ("(pre)", "(suf)", "(mid)")).alias("back")).collect()
    assert {r.n for r in rows} == {4} and {r.form for r in rows} == {"psm", "spm"}
    assert all(r.back == f" one  two three{r.doc_id}\nfour " for r in rows)
    ends = {0} | {m.end() for m in re.finditer(r"\S+\s*", " one  two three1\nfour ")}
    assert {r.prefix_chars for r in rows if r.doc_id < 10} <= ends
    with pytest.raises(ValueError):
        fim.transform(docs, id_col="n", text_col="output", units="x*")


def test_matcher_holds_no_units():
    pattern, text = re.compile(r"\w+"), "ab cd ef"
    assert fim.count_units(pattern, text) == 3
    assert [fim.ends_at(pattern, text, a, b) for a, b in ((0, 0), (0, 3), (1, 1), (1, 2), (3, 3))] == [(0, 0), (0, 8), (2, 2), (2, 5), (8, 8)]


def test_fill_in_the_middle_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(SQL["op12_fill_in_middle"])
    got = queries.op12_fill_in_middle(spark, sf)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# --- whitening

VECTORS = "vec_id long, embedding array<float>, component int, n string"


def brute_white(rows, components=8):
    ok = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in ok], np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * e.sum()).sum()))
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return [i for i, _ in ok], n, dev, centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def check_white(got, rows):
    ids, n, dev, white, share = brute_white(rows)
    at = collections.defaultdict(dict)
    for r in got:
        at[r.vec_id][r.component] = r
    assert set(at) == set(ids) and len(got) == len(ids) * len(share)
    for c in range(1, len(share) + 1):
        mine = np.array([at[i][c].whitened for i in ids])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.abs(mine - sign * white[:, c - 1]).max() < 1e-8
        assert abs(at[ids[0]][c].explained / share[c - 1] - 1) < 1e-9
    assert all(r.n == n and r.deviation == d for i, d in zip(ids, dev, strict=True) for r in at[i].values())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(1, 3, 12)) + 5
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    odd = [(1000, None), (1001, []), (1002, [float("nan")] + [1.0] * 11), (1003, [float("inf")] + [1.0] * 11), (1004, [None] + [1.0] * 11)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], VECTORS).repartition(40)
    got = whitening.whiten(df)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check_white(got.collect(), rows + odd)
    with_short = df.unionAll(spark.createDataFrame([(2000, [1.0, 2.0], 1, "x")], VECTORS))
    check_white(whitening.whiten(with_short).collect(), rows)


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(make(rows)).count() == 0
    flat = [(i, [float(i), float(i % 3), 7.0, 7.0]) for i in range(20)]
    check_white(whitening.whiten(make(flat)).collect(), flat)
    twice = make(flat + flat + [(None, [1.0, 1.0, 7.0, 7.0])])
    got = whitening.whiten(twice).collect()
    assert len(got) == 41 * 2 and {r.n for r in got} == {41}
    far = whitening.whiten(make([(i, [1e30 * (-1) ** i, float(i)]) for i in range(9)])).collect()
    assert len(far) == 18 and all(np.isfinite(r.whitened) for r in far)


def test_deviation_beyond_long_is_null(spark):
    model = whitening.Whitening(1, 1 << 30, np.array([0]), np.ones(1), np.ones((1, 1)), 1.0)
    assert model.deviations(np.array([[2], [3], [4]])) == [1 << 62, None, None]


def test_moments_merge_in_any_cut():
    x = np.random.default_rng(1).integers(90_000, 110_000, (500, 6))
    whole = whitening.Moments(6)
    for lo, hi in ((0, 1), (1, 300), (300, 300), (300, 500)):
        part = whitening.Moments(6)
        part.add(x[lo:hi])
        whole.merge(part.n, part.sums, part.mean, part.m2)
    assert whole.n == 500 and (whole.sums == x.sum(0)).all()
    assert np.allclose(whole.m2 / 500, np.cov(x.T, bias=True), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.ones((n, n)), np.diag(np.arange(n) * 1e8)):
        a = a + a.T
        e, u = whitening.symmetric_qr(a)
        size = max(np.abs(a).max(), 1)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size * n)
        assert np.abs(u @ u.T - np.eye(n)).max() < 1e-12 and np.abs(u @ a - e[:, None] * u).max() < 1e-12 * size * n
