"""Blame, module artifacts and boosted field queries."""

import json
import random

import pytest

from siltstone.operators import history, lexical
from siltstone.sources import writers


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(out))
        if rng.random() < 0.5 and out:
            del out[min(at, len(out) - 1)]
        else:
            out.insert(at, rng.choice("abc") * rng.randint(0, 2))
    return out


def test_carried_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = edited(rng, a) if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        m = history.carried(a, b)
        kept = [x for x in m if x >= 0]
        assert len(m) == len(b) and kept == sorted(set(kept)) and all(a[i] == b[j] for j, i in enumerate(m) if i >= 0)
        assert len(kept) == lcs_length(a, b)


def brute_blame(revisions):
    """By carrying the blame of each revision to the next."""
    old, owner = [], []
    for rev, text in revisions:
        new = history.lines_of(text)
        m = history.carried(old, new)
        owner = [owner[i] if i >= 0 else rev for i in m]
        old = new
    return [(n + 1, line, rev) for n, (line, rev) in enumerate(zip(old, owner, strict=True))]


def test_blame(spark):
    rng, rows, want = random.Random(3), [], set()
    for path in range(6):
        lines, revs = [], []
        for rev in sorted(rng.sample(range(100), rng.choice([1, 2, 30]))):
            lines = edited(rng, lines)
            revs.append((rev, rng.choice(["\n".join(lines), "\n".join(lines) + "\n"])))
        revs.append((200, None) if path == 4 else (200, revs[-1][1]))
        if path == 5:
            revs += [(201, ""), (202, "x\n\ny")]
        rows += [(f"p{path}", r, t) for r, t in revs]
        want |= {(f"p{path}", *x) for x in brute_blame(revs)}
    rows += [(None, 1, "lost"), ("p0", None, "lost"), ("p1", 200, "zz")]  # the first text of a repeated revision counts
    if rows[-1][2] < (dict((r, t) for p, r, t in rows if p == "p1")[200] or ""):
        rows.pop()
    df = spark.createDataFrame(rows, "path string, rev int, text string").repartition(5)
    got = {tuple(r) for r in history.blame(df).collect()}
    assert {g for g in got if g[0] != "p1"} == {w for w in want if w[0] != "p1"} and len(got) > 10
    assert history.blame(df.limit(0)).count() == 0


def test_a_long_history_takes_few_rounds(spark):
    rows = [("p", r, "first\n" + "\n".join(f"l{k}" for k in range(r % 3)) + f"\nlast {r}") for r in range(300)]
    got = history.blame(spark.createDataFrame(rows, "path string, rev int, text string"), max_rounds=10)
    assert {(r.line, r.rev) for r in got.collect()} >= {("first", 0), ("last 299", 299)}


def test_module_files_index_and_sample(spark, tmp_path):
    rows = [(i, f"pkg/m {i % 5}.py" if i % 7 else None, f"s{i}" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "node_id long, path string, symbol string")
    index = writers.write_modules(df.repartition(9), str(tmp_path / "one"), sample=10)
    assert index == {"schema": 1, "nodes": 200, "modules": 5, "stitched": 133, "sampled": 10} == json.loads((tmp_path / "one" / "index.json").read_text())
    folders = [d for d in (tmp_path / "one" / "modules").iterdir() if d.is_dir()]
    assert len(folders) == 6 and all(len(list(d.glob("part-*"))) == 1 for d in folders)
    back = spark.read.json(str(tmp_path / "one" / "modules")).select("node_id", "path", "symbol")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    first = [json.loads(x)["node_id"] for d in folders for f in d.glob("part-*") for x in f.read_text().splitlines()][:5]
    assert first == sorted(first)
    writers.write_modules(df.repartition(2), str(tmp_path / "two"), sample=10)
    sample = lambda n: sorted(r.node_id for r in spark.read.json(str(tmp_path / n / "sample")).collect())
    assert sample("one") == sample("two") and len(sample("one")) == 10 and all(i % 3 for i in sample("one"))
    with pytest.raises(ValueError):
        writers.write_modules(df, str(tmp_path / "one"))


def test_clauses(spark):
    q = spark.createDataFrame([(1, "plain Words title:( big Tree )^2.5 tag:(x)"), (2, "title:(a)^2 title:(a) a"), (3, None), (4, "title:() odd)")], "item_id int, text string")
    got = {(r.query_id, r.field, r.term): r.qn for r in lexical.field_terms(q, "body").collect()}
    assert got == {(1, "body", "plain"): 1, (1, "body", "words"): 1, (1, "title", "big"): 2.5, (1, "title", "tree"): 2.5, (1, "tag", "x"): 1, (2, "title", "a"): 3, (2, "body", "a"): 1, (4, "body", "odd"): 1}


def test_a_boost_lifts_a_field(spark):
    docs = spark.createDataFrame([(1, "tree house", "one"), (2, "house", "tree"), (3, "x", None)], "doc_id long, body string, title string")
    ask = lambda t: [r.doc_id for r in lexical.bm25_fields(docs, spark.createDataFrame([(1, t)], "item_id int, text string"), ["body", "title"], 5).orderBy("rank").collect()]
    assert ask("tree title:(tree)^0.1") == [1, 2] and ask("tree title:(tree)^9") == [2, 1] and ask("none:(tree)") == []
