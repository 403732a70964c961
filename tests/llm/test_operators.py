"""Each operator against a brute-force version, on odd rows as on plain ones."""

import collections
import datetime
import decimal
import hashlib
import math
import random
import re
import textwrap
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, hmm, html, language, licenses, mixing, neardup, neighbours, shingles, substrings, urls
from siltstone.llm.common import checkpoint_root, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, h string, __n long"


def rows_of(texts, start=0):
    return [(None if i == -1 else i, t, "en", "src0", len(t or ""), "b", None, 1) for i, t in texts]


def odd_texts():
    rng = random.Random(3)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(rng.randint(0, 60)) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    shared = "this passage of more than fifty bytes is found in many documents of the table"
    texts = [(3, None), (4, ""), (5, "   \n\t "), (10, base), (11, base), (12, base + " tail"), (13, " ".join(near)), (9, base.upper()), (20, f"one {shared} two"), (21, f"three {shared} four é" + "é" * 60), (22, "é" * 60), (30, "!!! 123"), (31, "short one"), (32, "short one"), (10, base), (40, "aaaa" * 3000), (41, "a" * 100), (-1, shared)]
    texts += [(100 + i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(rng.randint(1, 90)))) for i in range(40)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(odd_texts()), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- suffix-array deduplication


def brute_substrings(texts):
    first, out = {}, []
    order = sorted((t for t in texts if t[0] != -1), key=lambda x: x[0])
    for i, text in order:
        b = (text or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, text in order:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        spans = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("pack", [300, 1 << 20])
def test_substrings(docs, pack, monkeypatch):
    monkeypatch.setattr(substrings, "PACK_BYTES", pack)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(substrings, "FREQUENT_DOCS", 2)
    got = substrings.remove_repeats(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    shared = odd_texts()[17][1].encode()
    want = brute_substrings(odd_texts()) + [(None, len(shared), 0, 0, hashlib.sha256(shared).hexdigest())]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_cut_repeats_keeps_columns(docs):
    got = substrings.cut_repeats(docs)
    assert got.dtypes == docs.dtypes
    by = {r.doc_id: r for r in got.collect()}
    assert 11 not in by and by[10].text == odd_texts()[3][1] and by[10].bucket == "b" and by[10].h is None
    assert by[20].text.startswith("one ") and "passage" in by[20].text and "passage" not in by[21].text


def test_cut_repeats_keeps_types_and_string_ids(spark):
    shared = "this passage of more than fifty bytes is found in many documents of the table"
    rows = [(f"d{i}", f"text {i} {shared} and {i}", datetime.datetime(2024, 1, 1, 0, 0, 0, 123456), {i: "x"}, decimal.Decimal("1.10"), [i], b"\0\xff", datetime.date(2024, 2, 3), None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, text string, at timestamp, m map<int,string>, d decimal(10,2), rest array<long>, more binary, day date, pack struct<a:int>").repartition(3)
    got = substrings.cut_repeats(df)
    assert got.dtypes == df.dtypes
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == 20
    for r in rows:
        g = by[r[0]]
        assert (g["at"], g["m"], g["d"], g["rest"], bytes(g["more"]), g["day"], g["pack"]) == r[2:]
        assert (shared in g.text) == (r[0] == "d0")  # d0 is the first in the order of strings
    found = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    want = brute_substrings([(i, t) for i, (_, t) in enumerate(sorted((r[0], r[1]) for r in rows))])
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(found.items())] == [w[1:] for w in want]


def test_long_packs_in_slices(monkeypatch):
    rng = np.random.default_rng(8)
    lens = np.array([700, 0, 30, 4000, 50, 49, 900])
    flat = rng.integers(97, 100, lens.sum()).astype(np.uint8)
    whole = substrings.segments(flat, lens)
    monkeypatch.setattr(substrings, "SLICE", 257)
    cut = substrings.segments(flat, lens)
    windows = lambda f: sorted((int(s) + j, int(a), int(d)) for s, n, a, d in zip(f["start"], f["n"], f["anchor"], f["doc"]) for j in range(n))
    assert windows(cut) == windows(whole) and len(windows(whole)) == sum(max(0, n - 49) for n in lens)


def test_a_very_long_text(spark):
    words = " ".join(f"w{i * 7919 % 400_009}" for i in range(1_200_000))
    docs = spark.createDataFrame([(1, words), (2, "short one " + words[5_000_000:5_000_400]), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert len(words) > 8_000_000 and got[1].n_removed == 0 and got[2].n_removed >= 400 and got[2].n_spans == 1 and got[3].n_bytes == 0


def test_frequent_strings_are_asked_for_once_a_task(spark, monkeypatch):
    rule = "-" * 300
    texts = [(i, f"{i} {rule}\n{i * 31} x {rule} {i}") for i in range(200)]
    monkeypatch.setattr(substrings, "PACK_BYTES", 800)
    got = substrings.remove_repeats(spark.createDataFrame(rows_of(texts), DOCS).coalesce(1))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_substrings(texts))


def test_previous_factors():
    texts = ["banana", "ananas", "nab", "banana"]
    suffixes = sorted((t[i:], d) for d, t in enumerate(texts) for i in range(len(t)))
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    lcp = np.array([0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])])
    got = substrings.previous_factors(np.array([d for _, d in suffixes]), lcp)
    want = [max([common(s, t) for t, e in suffixes if e < d] or [0]) for s, d in suffixes]
    assert got.tolist() == want


# --- licences


def test_licenses(spark, docs, empty):
    extra = [(1, "Intro.\nReleased under the MIT licence.\nMore"), (2, "RELEASED UNDER THE MIT LICENSE"), (3, "x\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.\n"), (4, None), (5, ""), (6, "word " * 5000), (7, "Released under the license"), (8, "released under the mit license " * 3), (9, "a\n" + "Released   under - the  MIT\tLicense" + " " * 4000)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows_of(extra), DOCS)).collect()}

    def dice(a, b):
        x, y = set(licenses.bigrams(a)), set(licenses.bigrams(b))
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0

    for i, text in extra:
        units = (text or "").split("\n")
        units += [text or ""] if len(units) > 1 else []
        best = [max(((dice(u, t), n) for n, t in licenses.TEMPLATES.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]])) for u in units]
        hits = [b for b in best if b[0] >= licenses.THRESHOLD]
        assert got[i].n_matches == len(hits), i
        assert abs(got[i].score - max([h[0] for h in hits], default=0)) < 1e-9
        assert (got[i].license is None) == (not hits)
    assert got[2].license == "MIT" and got[3].n_matches == 2
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0
    assert licenses.scan(docs, {}).where("license is not null").count() == 0


def test_wrapped_and_whole_licenses(spark):
    mit = ["MIT License", "", "Copyright (c) 2020 Some Body", ""] + re.sub(r"(.{50,60}) ", r"\1\n", dict(licenses.PARAGRAPHS)["MIT"]).split("\n") + ["", "The above copyright notice and this permission notice shall be included in all copies.", "word " * 120]
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    isc = "# Permission to use, copy, modify, and/or distribute this software for any\n#\n# purpose with or without fee is hereby granted"
    extra = [(1, "\n".join(mit)), (2, f"A header of the file that says nothing of note\n{bsd}\nand then the list of those conditions follows here"), (3, f"import this and that from there\n{isc}\nimport some more of those and run"), (4, f"{bsd}\nlonger words of a text that go on and on\n\n{bsd}\n{'x ' * 300}"), (5, "word\nReleased under\nthe MIT License\nword\nword\nword"), (6, "Released under\n" + "x " * 300 + "\nthe MIT License"), (7, "Released under the MIT License\nthe\nx\ny\nz")]
    got = {r.doc_id: (r.license, r.n_matches) for r in licenses.scan(spark.createDataFrame(rows_of(extra), DOCS)).collect()}
    both = "BSD-2-Clause OR BSD-3-Clause"
    assert got == {1: ("MIT", 1), 2: (both, 1), 3: ("0BSD", 1), 4: (both, 2), 5: ("MIT", 1), 6: (None, 0), 7: ("MIT", 1)}


def _wrapped(*paragraphs):
    return "\n\n".join(textwrap.fill(p, 78) for p in paragraphs)


def test_licenses_that_share_sentences_or_differ_by_version(spark):
    p = dict(licenses.PARAGRAPHS)
    bsd = [licenses.TEMPLATES["BSD-2-Clause OR BSD-3-Clause"] + ":", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. " + p["BSD-2-Clause"]]
    name = "3. " + p["BSD-3-Clause"].replace("the copyright holder", "Some Body Inc.")
    disclaimer = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    gpl = "licensed under the GNU General Public License, version {}."
    cases = {
        "BSD-2-Clause": [*bsd, disclaimer], "BSD-3-Clause": [*bsd, name, disclaimer], "BSD-4-Clause": [*bsd, "3. " + p["BSD-4-Clause"], name, disclaimer],
        "0BSD": [licenses.TEMPLATES["0BSD"] + ".", "THE SOFTWARE IS PROVIDED AS IS"], "ISC": [p["ISC"], "THE SOFTWARE IS PROVIDED AS IS"],
        "GPL-2.0": ["x", gpl.format(2)], "GPL-3.0": ["x", gpl.format(3)], None: [gpl.format(1), "Mozilla Public License Version 2.0"],
        **{n: [p[n]] for n in ("AGPL-3.0", "LGPL-3.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "CC-BY-SA-4.0", "CC-BY-NC-ND-4.0", "MPL-2.0")},
    }
    rows = [(i, join(paragraphs)) for i, (paragraphs, join) in enumerate((c, j) for c in cases.values() for j in (lambda x: _wrapped(*x), "\n".join))]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows_of(rows), DOCS)).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n in cases for _ in range(2)]


def test_license_runs_against_brute_force(spark):
    """Every line, whole text and run of lines against every template, without any pruning."""
    texts = sorted([*licenses.TEMPLATES.items(), *licenses.PARAGRAPHS])
    found = [(n, set(licenses.bigrams(t)), set(licenses.versions(t))) for n, t in texts]

    def best(w):
        g = set(licenses.bigrams(" ".join(w)))
        rated = [(-2 * len(g & b) / (len(g) + len(b)), k) for k, (_, b, v) in enumerate(found) if v <= set(w)]
        return min((m for m in rated if -m[0] >= licenses.THRESHOLD), default=None)

    def brute(text):
        lines = [w for x in text.split("\n") if (w := re.findall("[a-z0-9]+", x.lower()))]
        own = [best(w) for w in lines]
        runs = []
        for i in range(len(lines)):
            for n in range(2, len(lines) - i + 1):
                if n < len(lines) and not any(own[i : i + n]) and (m := best(sum(lines[i : i + n], []))):
                    runs.append((*m, i, n))
        kept = []
        for m in sorted(runs):
            if not any(m[2] < k[2] + k[3] and k[2] < m[2] + m[3] for k in kept):
                kept.append(m)
        hits = [h for h in own if h] + [m[:2] for m in kept]
        if "\n" in text and (m := best(sum(lines, []))):
            hits.append(m)
        if not hits:
            return None, 0.0, 0
        name, names = found[min(hits)[1]][0], {found[k][0] for _, k in hits}
        for nest in licenses.NESTED:
            if name in nest:
                name = next(x for x in nest if x in names)
        return name, round(-min(hits)[0], 9), len(hits)

    rng = random.Random(7)
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(texts)[1].split()
            words += t[rng.choice([0, 0, 1, 3]) : len(t) - rng.choice([0, 0, 1, 3])] + rng.choices(["the", "license", "software", "alpha", "2"], k=rng.randint(0, 5))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "change"
        rows.append((i, "".join(w + ("\n" if rng.random() < 0.15 else " ") for w in words)))
    got = {r.doc_id: (r.license, r.score, r.n_matches) for r in licenses.scan(spark.createDataFrame(rows_of(rows), DOCS)).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert len({g[0] for g in got.values()}) > 10 and any(g[2] > 1 for g in got.values())
    # with other templates and thresholds, one of a single word among them
    own = {"a": "unlicense", "b": "alpha beta gamma delta epsilon", "c": "alpha beta gamma"}
    rows = [(1, "unlicense"), (2, "x\nUnlicense\ny"), (3, "alpha\nbeta gamma\ndelta epsilon zeta"), (4, "alpha beta\ngamma and\nunlicense")]
    got = {r.doc_id: (r.license, r.n_matches) for r in licenses.scan(spark.createDataFrame(rows_of(rows), DOCS), own, threshold=0.7).collect()}
    assert got[1] == ("a", 1) and got[2] == ("a", 1) and got[3][0] in ("b", "c") and got[4][1] == 2


def test_license_scan_of_long_text_of_short_lines(spark):
    """Lines of words that licences use, 0.5 MB in one row: no run of them is near a template."""
    rng = random.Random(1)
    text = "\n".join(" ".join(rng.choices("the to by under general software license public use of".split(), k=4)) for _ in range(20_000))
    rows = rows_of([(1, text), (2, text + "\nReleased under\nthe MIT License\nx")])
    began = time.time()
    got = {r.doc_id: (r.license, r.n_matches) for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (None, 0), 2: ("MIT", 1)} and time.time() - began < 60


# --- language


def test_language(spark, empty):
    rng = random.Random(1)
    letters = {"aa": "aeiou", "bb": "bcdfg", "cc": "éàüñ"}
    texts = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(40)), lang) for i, lang in enumerate(rng.choice(list(letters)) for _ in range(300))]
    rows = [(i, t, lang, "s", 1, "b", None, 1) for i, t, lang in texts] + [(900, None, "aa", "s", 0, "b", None, 1), (901, "", None, "s", 0, "b", None, 1), (902, "123 !!", "aa", "s", 0, "b", None, 1), (903, "aeiou " * 20_000, None, "s", 0, "b", None, 1), (None, "bcdfg bcd", "bb", "s", 0, "b", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    net = language.train(docs)
    got = language.predict(docs, net)
    by = {r.doc_id: r for r in got.collect()}
    held = [(i, lang) for i, _, lang in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(by[i].lang_pred == lang for i, lang in held) > 0.97 * len(held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in by.values())
    assert language.train(empty) is None and language.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    kept = language.keep_known(docs)
    assert kept.dtypes == docs.dtypes and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == 302


def test_language_network_against_plain_loops():
    net = language.ByteCnn(["a", "b", "c"], seed=2)
    x = np.random.default_rng(3).integers(0, 256, (5, language.LENGTH)).astype(np.uint8)
    got = net.probabilities(x)
    for row, p in zip(x, got):
        h = []
        for table, bias in zip(net.tables, net.bias):
            sums = [sum(table[j, row[i + j]] for j in range(len(table))) for i in range(language.LENGTH - len(table) + 1)]
            h += [max(0.0, max(s[f] for s in sums) + bias[f]) for f in range(language.FILTERS)]
        z = np.array(h) @ net.out + net.out_bias
        assert np.abs(np.exp(z) / np.exp(z).sum() - p).max() < 1e-5


def test_language_learns_from_whole_texts_and_all_labels(spark):
    """A language beyond 500 others is learned, and one that only shows late in its texts."""
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    late = [(i, " ".join([word("bcdfg") for _ in range(300)] + [word("éàüñ") for _ in range(300)]), "late") for i in range(0, 60)]
    early = [(i, " ".join(word("bcdfg") for _ in range(600)), "early") for i in range(60, 120)]
    docs = spark.createDataFrame(late + early, "doc_id long, text string, lang string")
    found = language.training_windows(docs, "doc_id", "text", "lang", 400).toPandas()
    assert found.l.value_counts()["late"] > 60 * 600 * 6 / 128 / 2 and len(set(found.x)) > 0.9 * len(found)
    rare = [(1000 + i, f"{word('xyzvw')} " * 30, f"rare{i % 600}") for i in range(3000)]
    found = language.training_windows(docs.unionByName(spark.createDataFrame(rare, docs.schema)), "doc_id", "text", "lang", 400)
    assert found.select("l").distinct().count() > 590 and found.count() < 2 * language.WINDOWS
    net = language.train(docs)
    got = language.predict(spark.createDataFrame([(1, " ".join(word("éàüñ") for _ in range(50)))], "doc_id long, text string"), net).first()
    assert got.lang_pred == "late"


# --- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x[50:120] = x[7]
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)] + [(400, None, "x", 1), (401, [0.0] * 8, "x", 1), (402, [float("nan")] * 8, "x", 1), (403, [1.0, None] * 4, "x", 1), (404, [1.0], "x", 1), (None, x[0].tolist(), "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, v long")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, k=5).orderBy("query_id", "rank").collect():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
        got[r.query_id].append((r.rank, r.vec_id))
    hit = 0
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:5]
        assert [r for r, _ in got[q]] == list(range(1, 6))
        hit += len(set(best) & {v for _, v in got[q]})
    assert hit >= 0.9 * 100 and set(got) == set(range(0, 400, 20))
    same = [v for _, v in got[60] if v in {7, *range(50, 120)}]
    assert same == [7, *range(50, 120)][: len(same)] and len(same) > 2
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id = 20")).count() == 0


def test_neighbours_are_k_distinct_ids(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(2)]
    rows += [(i, (x[i] * f).tolist()) for i in range(0, 300, 20) for f in (0.5, 0.9)]
    got = collections.defaultdict(list)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=150).collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, 300, 20))
    assert all(len(v) == len(set(v)) == 150 and q not in v for q, v in got.items())
    assert {len(got[q]) for q in got} == {150}
    few = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id < 25"), k=30)
    assert few.groupBy("query_id").count().where("count = 24").count() == 2


def test_best_counts_an_id_once():
    v = np.eye(4)
    ids = np.array([1, 5, 5, 5, 5, 6, 7])
    x = np.array([v[0] * 9, v[0] * 3, v[0] * 2, v[0] * 4, v[0] * 4, v[0], v[0] * 0.5])
    whole = lambda lo, hi: [(0, len(ids), np.arange(hi - lo))]
    ((query, found, score),) = neighbours._best(ids, x, np.array([1]), v[:1], whole, 2)
    assert query == 1 and list(zip(found, score, strict=True)) == [(5, 4.0), (6, 1.0)]


def test_neighbours_prune(spark):
    """Beyond 400 vectors: lists aren't all read, and recall holds against brute force."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 32))
    x = centre[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32)) * 0.7
    x[1000:3000] = x[7]  # copies hold a third of all rows
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>").repartition(4)
    report: dict = {}
    ask = [i for i in range(0, 6000, 40) if not 1000 <= i < 3000]
    got = collections.defaultdict(set)
    for r in neighbours.search(df, df.where(F.col("vec_id").isin([f"v{i}" for i in ask])), report=report).collect():
        got[int(r.query_id[1:])].add(int(r.vec_id[1:]))
    hit = 0
    for i in ask:
        s = x @ x[i]
        s[i] = -np.inf
        least = np.sort(s)[-20] - 1e-9
        assert len(got[i]) == 20
        hit += sum(s[j] >= least for j in got[i])
    assert hit >= 0.9 * 20 * len(ask), hit
    assert report["share"] < 0.45 and 1 <= report["copies"] < 2 and report["lists"] > 500, report


def test_neighbours_fit_holds_few_distances():
    x = np.random.default_rng(5).normal(size=(4096, 8))
    tracemalloc.start()
    index = neighbours.Index(x, float(np.linalg.norm(x, axis=1).max()), 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lists = len(index.centroids)
    assert lists > 4000 and index.graph.shape == (lists, neighbours.DEGREE + 5)
    assert peak < 100 << 20  # all distances of 4,096 lists and their orders: 193 MB
    far = neighbours._squared(index.centroids[:50], index.centroids)
    assert all(set(np.argsort(d)[: neighbours.DEGREE]) <= set(g) for d, g in zip(far, index.graph, strict=False))


def test_neighbours_in_pieces_blocks_and_batches(spark, monkeypatch):
    """Pieces, blocks of queries and batches that cut groups anywhere change no row."""
    x = np.random.default_rng(8).normal(size=(1200, 8))
    x[300:700] = x[5]  # one list that no piece holds whole
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    run = lambda: neighbours.search(df, k=7, every=2).orderBy("query_id", "rank").collect()
    want = run()
    monkeypatch.setattr(neighbours, "PIECE", 256)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        assert run() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) == 600 * 7


# --- mixing


def test_raking_meets_marginals(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10.0), ("a", "y", "t", 30.0), ("b", "x", "u", 40.0), ("b", "y", "t", 20.0), ("b", "y", "u", 5.0)], "source string, lang string, topic string, c double")
    got = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}}, 60).toPandas()
    assert abs(got.w.sum() - 105) < 1e-6
    assert abs(got[got.source == "a"].w.sum() / 105 - 0.5) < 1e-3 and abs(got[got.lang == "x"].w.sum() / 105 - 0.4) < 1e-3
    p = mixing.calibrate(mixing.rake(cells), 0.6).toPandas()
    assert abs((p.c * p.p).sum() - 0.6 * 105) < 1e-6 and p.p.between(0, 1).all()


def test_raking_odd_cells(spark):
    kind = "source string, lang string, topic string, c double"
    rows = [("a", "x", "t", 10.0), ("a", "x", "t", 10.0), (None, "x", "t", 30.0), ("unknown", "y", None, None), ("b", "y", "t", -3.0), ("b", "x", "u", 0.0), ("c", "z", "u", 5.0)]
    got = mixing.rake(spark.createDataFrame(rows, kind), {"source": {"a": 0.6, "unknown": 0.4}}, 40).toPandas()
    by = got.groupby("source").w.sum()
    assert len(got) == 7 and by["c"] == by["b"] == 0 and got[got.source == "a"].w.nunique() == 1 and (got.w >= 0).all()
    assert mixing.rake(spark.createDataFrame([], kind)).count() == 0 and mixing.calibrate(mixing.rake(spark.createDataFrame([], kind))).count() == 0
    assert mixing.rake(spark.createDataFrame([("a", "x", "t", 0.0)], kind)).first().w == 0


@pytest.mark.parametrize(("at_most", "upto"), [(200_000, None), (3, 3)])
def test_raking_goes_on_until_all_marginals_are_met(spark, monkeypatch, at_most, upto):
    """More rounds than eight in one partition, three of them joined; equal to plain loops."""
    monkeypatch.setattr(mixing, "CELLS_A_TASK", at_most)
    cells = [("a", "x", "t", 40.0), ("a", "y", "t", 30.0), ("b", "x", "u", 20.0), ("b", "y", "t", 35.0), ("b", "y", "u", 25.0), ("a", "x", "u", 15.0), ("a", "y", "u", 20.0)]
    goal = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"t": 0.45, "u": 0.55}}
    w, rounds = [c[3] for c in cells], 0
    while True:
        worst, rounds = 0, rounds + 1
        for i, d in enumerate(goal):
            for v, t in goal[d].items():
                f = t * 185 / sum(x for x, c in zip(w, cells, strict=True) if c[i] == v)
                worst = max(worst, abs(f - 1))
                w = [x * f if c[i] == v else x for x, c in zip(w, cells, strict=True)]
        if worst <= mixing.TOLERANCE or rounds == upto:
            break
    assert rounds > 8 or upto
    df = spark.createDataFrame(cells, "source string, lang string, topic string, c double")
    got = {(r.source, r.lang, r.topic): r.w for r in mixing.rake(df, goal, upto).collect()}
    assert all(abs(got[c[:3]] / x - 1) < 1e-9 for c, x in zip(cells, w, strict=True))
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        mixing.rake(df, goal)


def test_contradicting_marginals_end(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10.0), ("b", "y", "t", 30.0)], "source string, lang string, topic string, c double")
    got = {r.source: r.w for r in mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"t": 1.0}}).collect()}
    assert abs(got["a"] - 16) < 1e-9 and abs(got["b"] - 24) < 1e-9


def test_calibration_equals_the_sorted_sums(spark):
    rng = random.Random(4)
    cells = [(f"s{i}", "l", "t", rng.choice([5.0, rng.random() * 100]), rng.choice([0.0, 7.0, rng.random() * 300])) for i in range(40)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, c double, w double")
    for budget in (0.05, 0.6, 0.9, 1.0, 2.0):
        order = sorted(cells, key=lambda x: -x[4] / x[3])
        scale = None
        for n in range(len(order)):
            left = sum(x[4] for x in order[n:])
            s = (budget * sum(x[3] for x in cells) - sum(x[3] for x in order[:n])) / left if left else None
            if s is not None and s * order[n][4] / order[n][3] <= 1:
                scale = s
                break
        want = {x[0]: 0.0 if x[4] == 0 else 1.0 if scale is None else min(1.0, scale * x[4] / x[3]) for x in cells}
        for r in mixing.calibrate(df, budget).collect():
            assert abs(r.p - want[r.source]) < 1e-9, (budget, r)


def test_sampling(docs, empty):
    got = mixing.weigh(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        u = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) / 2**32
        assert r.kept == (u < r.p) and r.lang == "en" and r.source == "src0"
    count = lambda t: len(re.findall(r"[^ \t\n\x0B\f\r]+", t or ""))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.tokens) for r in got) == sorted((i, count(t)) for i, t in odd_texts())
    assert mixing.sample(docs).dtypes == docs.dtypes and mixing.sample(empty).count() == 0


# --- near duplicates


def brute_classes(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ids = sorted(i for i in sets if i != -1)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates(spark, docs, empty, small, monkeypatch, percent):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    texts = odd_texts()
    for i in range(40):  # a group of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"v{i}{rng.randint(0, 9)}"
        texts.append((500 + i, " ".join(w)))
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(3)
    got = neardup.classes(df, percent=percent).collect()
    want = brute_classes(texts, percent)
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.component_id == r.doc_id)
    assert neardup.classes(empty).count() == 0
    kept = neardup.keep_first(df, percent=percent)
    assert kept.dtypes == df.dtypes
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_duplicates_with_string_ids(spark):
    texts = [(i, t) for i, t in odd_texts() if i != -1]
    df = spark.createDataFrame([(f"k{i:04}", t, 1) for i, t in texts], "doc_id string, text string, _n long")
    want = brute_classes(texts)
    got = neardup.classes(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((f"k{i:04}", want[i][0], f"k{want[i][1]:04}", want[i][1] == i) for i, _ in texts)
    assert {r.doc_id for r in neardup.keep_first(df).collect()} == {f"k{i:04}" for i, (_, c) in want.items() if i == c}


def test_near_duplicates_of_long_texts(spark):
    words = [f"w{i}" for i in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:290_000])), (3, " ".join(words[:200_000]))], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs).collect()} == {1: (299_996, 1), 2: (289_996, 1), 3: (199_996, 3)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * 2)
    b, c = a[:280], a[40:]
    r = neardup.registers([b, c, np.union1d(b, c)])
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    jaccard = len(np.intersect1d(b, c)) / len(a)
    assert abs((r[0] == r[1]).mean() - jaccard) < 0.1
    size = np.array([100.0])
    assert neardup.likely(r[:1], r[:1], size, size)[0] and not neardup.likely(r[:1], neardup.registers([np.arange(1, 301, dtype=np.uint64) << np.uint64(40)]), size, size)[0]


def test_block_products():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(12)]
    got = neardup.intersections(sets[:5], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:5]]


def _tables(spark):
    """Folders and checkpoints in the shared folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath().toString()).rsplit("/", 1)[-1] for p in (top, spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())) for f in files.listStatus(p)}


def test_components_leave_their_result_alone(spark):
    checkpoint_root(spark)
    before = _tables(spark)
    got = {r.node: r.component for r in components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0)
    left = _tables(spark) - before
    assert len(left) == 1 and left.pop().startswith("components-")


def test_near_dedup_leaves_one_table(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:55] + [f"x{i}", f"y{i}"])) for i in range(30)] + [(99, "other words that nothing else here has")]
    checkpoint_root(spark)
    before = _tables(spark)
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {0, 99}
    left = _tables(spark) - before
    assert len(left) == 1 and left.pop().startswith("classes-")


def test_links_between_components_join_them(spark):
    label = components(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long"))
    found = spark.createDataFrame([(2, 4), (9, 6), (7, 8)], "a long, b long")
    got = {r.node: r.component for r in neardup._more(label, found, None).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 5, 7: 7, 8: 7}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 300), (300, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200, 300: 200, 250: 200}


# --- language model


def test_hmm(spark, docs, empty):
    texts = [t for t in odd_texts() if t[0] != -1]
    learn = [t for t in texts if zlib.crc32(str(t[0]).encode()) % 7 != 2]
    count = collections.Counter(w for _, t in learn for w in (t or "").encode().lower().split())
    n, v = sum(count.values()) + len(learn), len(count) + 1
    got = hmm.score(docs.where("doc_id is not null")).collect()
    assert len(got) == len(texts)
    by = {i: t for i, t in texts}
    for r in got:
        w = (by[r.doc_id] or "").encode().lower().split()
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [count[x] for x in w] + [len(learn)])
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.n_tokens == len(w) + 1 and r.train_tokens == n
        assert r.n_known == sum(count[x] > 0 for x in w) + 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    assert hmm.score(docs).count() == docs.count() and hmm.score(empty).count() == 0


def test_forward_is_exact_and_training_climbs():
    rng = np.random.default_rng(6)
    k, m = 3, 7
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k)
    seqs = [rng.integers(0, m, size) for size in (1, 4, 2, 4, 9)]
    got = hmm.forward(np.concatenate(seqs).astype(np.int32), np.array([len(s) for s in seqs]), start, move, np.ascontiguousarray(emit.T))
    for s, log in zip(seqs, got):
        a = start * emit[:, s[0]]
        for x in s[1:]:
            a = (a @ move) * emit[:, x]
        assert abs(math.log10(a.sum()) - log) < 1e-9
    ids, lengths = np.concatenate(seqs).astype(np.int32), np.array([len(s) for s in seqs])
    before = got.sum()
    for _ in range(5):
        s, t, e = hmm.expected(ids, lengths, start, move, np.ascontiguousarray(emit.T))
        assert abs(e.sum() - lengths.sum()) < 1e-6 and abs(s.sum() - len(seqs)) < 1e-6 and abs(t.sum() - (lengths - 1).sum()) < 1e-6
        start, move, emit = s / s.sum(), t / t.sum(1, keepdims=True), e[:, :m] / e.sum(1, keepdims=True)
        after = hmm.forward(ids, lengths, start, move, np.ascontiguousarray(emit.T)).sum()
        assert after >= before - 1e-9
        before = after


def test_chunks_sum_up_to_whole_texts():
    rng = np.random.default_rng(9)
    k, m = 4, 11
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), np.ascontiguousarray(rng.dirichlet(np.ones(m), k).T)
    seqs = [rng.integers(0, m, size).astype(np.int32) for size in (1, 40, 7, 8, 23, 2)]
    ids, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    logs, sums, n = np.zeros(len(seqs)), None, 0
    for owner, *part in hmm.chunked(seqs, start, move, emit, 20, 7):
        logs += np.bincount(owner, hmm.forward(part[0], part[1], part[2], move, emit), len(seqs))
        got = hmm.expected(*part[:3], move, emit, *part[3:])
        sums = got if sums is None else [a + b for a, b in zip(sums, got)]
        n += 1
    assert n > 2 and np.abs(logs - hmm.forward(ids, lengths, start, move, emit)).max() < 1e-9
    for a, b in zip(sums, hmm.expected(ids, lengths, start, move, emit)):
        assert np.abs(a - b).max() < 1e-9


def test_hmm_score_is_a_probability(spark, monkeypatch):
    """score() against a plain forward pass with the same trained states, and sums to one over all one-word texts."""
    monkeypatch.setattr(hmm, "KNOWN_WORDS", hmm.HMM_WORDS + 500)  # of about 30,000 words: the others are joined
    rng = random.Random(12)
    long_ = "=" * 60
    common = ["a", "b", "c", "d", long_]
    texts = [(i, " ".join(rng.choice(common) if rng.random() < 0.2 else f"r{rng.randint(0, 60_000)}" for _ in range(rng.choice([1, 9, 600])))) for i in range(280)]
    texts.append((280, " ".join(rng.choice([*common, f"r{i}"]) for i in range(5000))))
    learn = [t for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kept = {}
    train, vocabulary = hmm.train, hmm.vocabulary
    monkeypatch.setattr(hmm, "train", lambda *a: kept.setdefault("state", train(*a)))
    monkeypatch.setattr(hmm, "vocabulary", lambda *a: kept.setdefault("words", vocabulary(*a)))
    got = {r.doc_id: r for r in hmm.score(docs).collect()}
    start, move, emit = kept["state"]
    assert np.abs(emit.sum(1) - 1).max() < 1e-9 and np.abs(move.sum(1) - 1).max() < 1e-9
    count = collections.Counter(w for t in learn for w in hmm.tokens(t))
    top = {w: k for k, w in enumerate(list(kept["words"].index)[: hmm.HMM_WORDS])}
    assert len(count) > len(kept["words"].index) > len(top) == hmm.HMM_WORDS and min(count[w] for w in top) >= max(c for w, c in count.items() if w not in top)
    room = collections.Counter()
    for w, c in count.items():
        if w not in top:
            room[zlib.crc32(w) % hmm.TAIL_CLASSES] += c + 1
    for i, t in texts:
        a, log = start, 0.0
        for n, w in enumerate([*hmm.tokens(t), None]):
            tail = None if w is None or w in top else zlib.crc32(w) % hmm.TAIL_CLASSES
            cls = hmm.END if w is None else top[w] if tail is None else hmm.HMM_WORDS + tail
            a = (a if n == 0 else a @ move) * emit[:, cls]
            if tail is not None:
                log += math.log10((count[w] + 1) / (room[tail] + 1))
            log += math.log10(a.sum())
            a = a / a.sum()
        assert abs(got[i].score - log) < 1e-6 * abs(log), i
    assert got[0].n_tokens == len(texts[0][1].split()) + 1 and hmm.tokens(long_)[0] != long_.encode() and len(hmm.tokens(long_)[0]) == 17


# --- urls


def test_urls(spark):
    pages = [
        (1, "http://a.example.NET/en/x?q#f", "<p>"), (2, "https://example.net", None), (3, "ftp://x.net/y", ""), (4, None, ""), (5, "nothing", ""),
        (6, "http://EXAMPLE.com/de/1", '<link rel="canonical" href="http://clean.example.com/z">'), (7, "http://clean.example.com/z#top", ""), (8, "http://e.org/fr/1", ""), (9, "http://e.org/de/1", "<META http-equiv=refresh content='0; URL=http://e.org/fr/1'>"),
        (10, "http://third.example.com/a", "<link href='http://clean.example.com/z' rel='canonical'>"), (11, "http://notexample.net/en/", ""), (1, "http://a.example.NET/en/x?q#f", "<p>"),
    ]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, host string, own long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "", None, "allow"), 3: ("x.net", "/y", "net/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("example.com", "/de/1", "example.com/de/", "block"), 7: ("clean.example.com", "/z", None, "block"), 8: ("e.org", "/fr/1", "org/fr/", "allow"), 9: ("e.org", "/de/1", None, "allow"),
        10: ("third.example.com", "/a", None, "block"), 11: ("notexample.net", "/en/", "net/", "block"),
    }
    assert urls.judge(df).count() == len(pages) and urls.judge(df.limit(0)).count() == 0
    more = spark.createDataFrame([("http://third.example.com/a", "http://e.org/fr/1")], "a string, b string")
    assert {r.page_id: r.verdict for r in urls.judge(df, edges=more).collect()}[7] == "allow"


def test_url_edges(spark):
    base = "http://A.example.org/x/y/z.html?q=1#f"
    pages = [
        (1, base, "<link rel=canonical href='/de/x'><link rel='canonical' href='//example.com/de/x'>", ["http://a.example.org/de/x", "http://example.com/de/x"]),
        (2, base, '<meta http-equiv="refresh" content="0;url=/fr/1"><meta http-equiv=refresh content="1; url=w">', ["http://a.example.org/fr/1", "http://a.example.org/x/y/w"]),
        (3, base, '<link href="?a=1&amp;b=2" rel="canonical"><link href="../k/./m/..?r" rel="canonical">', ["http://a.example.org/x/k/?r", "http://a.example.org/x/y/z.html?a=1&b=2"]),
        (4, base, '<link rel="canonical" href="http:&#47;&#x2f;e.org/p?a&#38;amp;b"><link rel="canonical" href="mailto:x@y"><link rel="canonical" href="#top">', ["http://a.example.org/x/y/z.html?q=1", "http://e.org/p?a&amp;b"]),
        (5, "http://e.org", "<link rel=canonical href='a/b'><link rel=canonical href='../../c'>", ["http://e.org/a/b", "http://e.org/c"]),
        (6, base, "<base href='//b.org/d/'><link rel=canonical href='e'>", ["http://b.org/d/e"]), (7, None, "<link rel=canonical href='/e'>", []), (8, "nothing", "<link rel=canonical href='/e'>", []),
    ]
    for i, url, page, want in pages:
        df = spark.createDataFrame([(url, page)], "url string, html string")
        assert sorted(r.b for r in urls.page_edges(df).collect()) == [w for w in want if w != "http://a.example.org/x/y/z.html?q=1"], i
    df = spark.createDataFrame([(1, "http://example.com/de/1", "<link rel=canonical href='/known'>"), (2, "http://example.com/known", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == {1: "block", 2: "block"}


# --- decontamination


def brute_hits(texts, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[j : j + width])].add(str(i))
    out = {}
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for p, owners in windows.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    found |= owners
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontaminate(spark, docs, empty, block):
    texts = odd_texts()
    base = texts[3][1].split()
    items = [(1, " ".join(base[5:30])), (2, "Short, ONE!"), (3, None), (4, ""), (10, " ".join(base[5:15]).upper()), (1, "passage of more than fifty bytes is found in many"), (7, "é" * 60)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, items string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=block).collect()
    want = brute_hits(texts, items)
    by = dict(texts)
    assert len(got) == len(texts)
    for r in got:
        d = -1 if r.doc_id is None else r.doc_id
        assert (r.n_words, r.n_hit, r["items"]) == want[d]
        for s in r.spans:
            assert by[d][s.start : s.end].strip() == by[d][s.start : s.end] != ""
        assert sum(len(by[d][s.start : s.end].encode().translate(decontaminate._NORMAL).split()) for s in r.spans) == r.n_hit
    clean = decontaminate.keep_clean(docs, bench, block_bytes=block)
    assert clean.dtypes == docs.dtypes and sorted(r.doc_id or -1 for r in clean.collect()) == sorted((-1 if d == -1 else d) for d, _ in texts if not want[d][1])
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


# --- html


def test_blocks_are_whole():
    page = "<html><head><title>No</title></head><body><p>a &amp; b\n c<br>d<p>e<b>f</b> <script>var x='</p>';</script>g</p><!-- <p>no --><div class='ad'>x &lt; y</div>1 < 2<ul><li>i<li>j</ul></body>"
    assert [t for _, t, _ in html.blocks(page)] == ["a & b c d", "ef g", "x < y", "1 < 2", "i", "j"]
    assert html.blocks(None) == [] and html.blocks("") == [] and html.blocks("plain") == [((), "plain", 0)]


def test_html(spark):
    net = html.train()
    rng = random.Random(77)
    wrong = total = 0
    for _ in range(150):
        page, labels = html.invented_page(rng)
        found = html.blocks(page)
        assert len(found) == len(labels)
        if found:
            wrong += int(((net.chances([html.vectors(found)])[0] > 0.5) != np.array(labels)).sum())
            total += len(labels)
    assert wrong < 0.03 * total
    body = "".join(f"<p>Sentence number {i}, which goes on for a while.</p>" for i in range(3000))
    pages = [(1, "u", f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title here.</h1>{body}</article><footer>&copy; x</footer>"), (2, None, None), (3, "v", ""), (3, "v", "")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = html.extract(df, net).collect()
    assert len(got) == 4
    text = next(r.text for r in got if r.page_id == 1)
    assert text.split("\n")[0] == "Title here." and len(text.split("\n")) == 3001 and "Home" not in text
    assert all(r.text == "" and r.n_blocks == 0 for r in got if r.page_id != 1)
    assert html.extract(df.limit(0), net).count() == 0


def test_html_keeps_text_after_custom_and_empty_elements():
    said = lambda page: [b[1] for b in html.blocks(page)]
    assert said('<article><p>A <svg-icon name="x"></svg-icon> b</p><p>Rest of the article.</p></article>') == ["A b", "Rest of the article."]
    assert said("<p>A <svg viewBox='0 0 > 1'/> b</p><p>c</p><script-x>d</script-x><template-y></template-y><p>e</p>") == ["A b", "c", "d", "e"]
    assert said("<p>Let <math><mi>x</mi></math> be</p><object data=a><p>No plugin.</p></object>") == ["Let x be", "No plugin."]
    assert said("<p>A</p><svg width=1><text>no</text></svg><script>no</script\n><STYLE >no</STYLE><p>b</p>") == ["A", "b"]


def test_html_long_and_broken_pages(spark):
    net = html.train()
    page = html.blocks("<article>" + "".join(f"<p>Sentence number {i}, which goes on.</p><nav><li><a>x</a></li></nav>" for i in range(6000)) + "</article>")
    assert len(page) > html.BATCH_BLOCKS
    assert np.abs(net.read(page) - net.chances([html.vectors(page)])[0]).max() < 1e-4
    began = time.time()
    for bad in ("<p class=\"x>a ", "<a \">\" ", "<a ", "<a \"'> ", "<div>x", "<b>y</i>", "<script>", "<!-- "):
        said = html.blocks("<article><p>First.</p>" + bad * (1_000_000 // len(bad)))
        assert said[0][1] == "First."
    assert time.time() - began < 30
    assert sum(t.count("x") for _, t, _ in html.blocks("<div>x" * 5000)) == 5000  # no text is lost at any depth
    long_ = "<html><body><article>" + "".join(f"<p>Long text {i} of a page.</p>" for i in range(2000)) + "</article><nav><ul><li><a href=x>Menu</a></li></ul></nav></body></html>"
    pages = spark.createDataFrame([(i, "u", long_) for i in range(3)] + [(9, "u", None), (10, "u", "")], "page_id long, url string, html string")
    runs = html._sampled(pages, "page_id", "html").collect()
    assert len(runs) == 24 and {len(r.y) for r in runs} == {256, 2001 - 7 * 256}
    assert html._sampled(pages.limit(0), "page_id", "html").count() == 0


#: Pages of three sites, written by hand, and the text that a reader would take from each.
HAND = [
    (
        """<!doctype html><html lang="en"><head><title>Kiln diary</title><style>p{margin:0}</style></head><body>
        <header class="masthead"><a href="/">Potters' Yard</a><nav><ul><li><a href="/a">Glazes</a></li><li><a href="/b">Clay</a></li></ul></nav></header>
        <div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div>
        <article><h1>A slow firing</h1><p>The kiln took nine hours to reach its top heat, and we let it cool for two days.</p>
        <p>Nothing cracked. The blue came out darker than on the test tiles &mdash; about two shades.</p>
        <aside class="related"><h3>Related</h3><ul><li><a href="/c">Test tiles</a></li></ul></aside>
        <p>Next week we try the same glaze on stoneware.</p></article>
        <section class="comments"><h2>Comments</h2><div class="comment"><p>Lovely blue!</p></div></section>
        <footer><p>&copy; Potters' Yard. All rights reserved.</p></footer></body></html>""",
        ["A slow firing", "The kiln took nine hours to reach its top heat, and we let it cool for two days.", "Nothing cracked. The blue came out darker than on the test tiles \u2014 about two shades.", "Next week we try the same glaze on stoneware."],
    ),
    (
        """<html><body><div id="top-nav"><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div>
        <div id="content"><h1>Bridge to close for repairs</h1><p>The old bridge will be closed to cars from Monday, the town said. Walkers may still cross.</p>
        <div class="ad-slot"><p>Advertisement</p></div>
        <p>Repairs will last until the autumn, and buses will take the long way round.</p>
        <blockquote>"We waited too long with this," said the mayor.</blockquote></div>
        <div class="sidebar"><h3>Popular</h3><p><a href=4>Fair opens</a></p><p><a href=5>Rain expected</a></p></div>
        <form class="search"><label>Search</label><input name=q><button>Go</button></form>
        <div id="footer"><p>Contact us. Privacy policy. Terms of use.</p></div></body></html>""",
        ["Bridge to close for repairs", "The old bridge will be closed to cars from Monday, the town said. Walkers may still cross.", "Repairs will last until the autumn, and buses will take the long way round.", '"We waited too long with this," said the mayor.'],
    ),
    (
        """<html><body><main><h1>Sourdough, step by step</h1><p>Mix flour and water and leave the dough alone for an hour.</p><ol><li>Add the salt and the starter.</li><li>Fold the dough four times, every half hour.</li></ol>
        <h2>Baking</h2><p>Heat the oven as far as it goes; bake with the lid on for twenty minutes.</p></main>
        <div class="share-buttons"><ul><li><a>Share</a></li><li><a>Tweet</a></li></ul></div>
        <div class="newsletter"><p>Subscribe to our newsletter</p></div><script>var a = "<p>no</p>";</script></body></html>""",
        ["Sourdough, step by step", "Mix flour and water and leave the dough alone for an hour.", "Add the salt and the starter.", "Fold the dough four times, every half hour.", "Baking", "Heat the oven as far as it goes; bake with the lid on for twenty minutes."],
    ),
]


def test_html_on_pages_written_by_hand(spark):
    df = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(HAND)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html.extract(df, html.train()).collect()}
    for i, (_, want) in enumerate(HAND):
        assert got[i] == want


def test_shingles_cover_long_texts():
    text = "w1 w2\tw3 " * 200_000
    assert len(next(iter(shingles.shingle_sets([text])))) == 3
