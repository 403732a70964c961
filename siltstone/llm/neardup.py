"""MinHash near-deduplication by SetSketch registers: band, estimate jointly by likelihood, verify on full sets.

A register is the smallest of n exponential variables, one a shingle, on a scale of powers of BASE. Registers of a
union are the maxima of the parts', so sketches merge. Register i of two sets agrees with a probability close to
their Jaccard similarity, as BASE is close to 1; BANDS groups of ROWS registers miss a link at similarity s with
probability (1 - s**ROWS)**BANDS: about 1.5e-4 at 0.8, 2e-7 at 0.85, and fewer above.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm.common import apart, components, discard, integral, numbered, together, written
from siltstone.llm.shingles import WORDS, mix, shingle_sets

BANDS, ROWS = 48, 8
REGISTERS = BANDS * ROWS
BASE = 1.002
#: Register values are cut to 0..LIMIT; RATE places a set of one shingle well inside.
LIMIT, RATE = 60_000, 20.0
#: 100 * intersection >= percent * union is a link, by default with this one; the bands are laid out for LEAST and more.
PERCENT, LEAST = 85, 80
#: A pair is dropped before verification only if its likelihood at the threshold is below the best by this much (7 sigma).
MARGIN = 24.5
#: Members of a band up to which its remaining pairs are listed; members of a block beyond that. Both compare every pair
#: that is left on full sets; only what travels differs (pairs, or whole blocks that are multiplied where they lie).
SMALL, BLOCK = 16, 512
_RNG = np.random.default_rng(577215)
_FACTOR = (_RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_SHIFT = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (len(sets), REGISTERS) of non-empty sets of 64-bit hashes."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (n == 0 or n + len(sets[to]) <= 65_536):
            n += len(sets[to])
            to += 1
        flat = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : to - 1]]))).astype(np.int64)
        low = np.empty((REGISTERS, to - at), np.uint32)
        work = np.empty_like(flat)
        for i in range(REGISTERS):
            np.multiply(flat, _FACTOR[i], out=work)
            work ^= _SHIFT[i]
            low[i] = np.minimum.reduceat(work, starts)
        exponential = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2**32)
        out[at:to] = np.clip(np.floor(1 - np.log(exponential / RATE) / np.log(BASE)), 0, LIMIT)
        at = to
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, which tells the band too."""
    parts = reg.reshape(len(reg), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _close(percent: int) -> str:
    """A link needs sets of about the same size."""
    return f"100 * least(n, ln) >= {percent} * greatest(n, ln)"


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """False where the registers rule out the threshold: joint likelihood of greater, equal and smaller registers."""
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    same = ra.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.append(np.linspace(0, 1, 201), percent / 100)[None, :]
    top = np.minimum(u / v, v / u)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = chance(u - v * grid), chance(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = sum(np.where(k == 0, 0, k * np.log(np.maximum(x, 1e-12))) for k, x in ((more, p), (less, q), (same, 1 - p - q)))
    logs = np.where(grid <= top + 1e-9, logs, -np.inf)
    best = grid[0, logs[:, :-1].argmax(1)]
    return (best >= percent / 100) | (logs[:, -1] >= logs.max(1) - MARGIN)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n (set size), s1 and s2 (a 128-bit signature of the set, null if empty), regs."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                sets = list(shingle_sets(list(part["text"])))
                full = [i for i, s in enumerate(sets) if len(s)]
                regs, s1, s2 = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    for i, r in zip(full, registers([sets[i] for i in full]), strict=True):
                        regs[i] = r.tobytes()
                        s1[i] = int(np.add.reduce(sets[i]).astype(np.uint64).view(np.int64))
                        s2[i] = int(np.add.reduce(mix(sets[i])).astype(np.uint64).view(np.int64))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n": [len(s) for s in sets], "s1": pd.array(s1, "Int64"), "s2": pd.array(s2, "Int64"), "regs": regs})

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInPandas(run, "doc_id long, n long, s1 long, s2 long, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, doc, n): one row a band of each representative."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                keys = band_keys(np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(len(pdf), -1))
                yield pd.DataFrame({"key": keys.ravel(), "doc": np.repeat(pdf["doc_id"].to_numpy(np.int64), BANDS), "n": np.repeat(pdf["n"].to_numpy(np.int64), BANDS)})

    return reps.select("doc_id", "n", "regs").mapInPandas(run, "key long, doc long, n long")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their registers don't rule out."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}"))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                ra, rb = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), -1) for c in ("ra", "rb"))
                ok = likely(ra, rb, pdf["na"].to_numpy(float), pdf["nb"].to_numpy(float), percent)
                yield pdf.loc[ok, ["a", "b"]]

    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                cache: dict[int, np.ndarray] = {}
                need = {**dict(zip(part["a"], part["ta"], strict=True)), **dict(zip(part["b"], part["tb"], strict=True))}
                cache = dict(zip(need, shingle_sets(list(need.values())), strict=True))
                keep = []
                for a, b in zip(part["a"], part["b"], strict=True):
                    x, y = cache[a], cache[b]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                    both = int((y[at] == x).sum()) if len(y) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.loc[keep, ["a", "b"]]

    side = lambda x: texts.select(F.col("doc").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, under: str | None = None) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept. Documents are linked from ``percent`` similarity on.

    Equal sets meet by signature, one representative of each goes on. In every band its members are paired with the
    smallest of them (a star, not all pairs). Each document is verified with its smallest partner first; then only
    pairs across components are: the other stars, then what is left between components within a band, pair by pair in
    small bands and by block products in larger ones. Pairs are pruned by set size and by the joint likelihood of their
    registers, with a margin of 7 sigma, before full sets are compared. Documents without words are linked with nothing. A null id has a null component and is kept. Rows that
    repeat an id share a component, each gives a row; of several texts under one id the first in order is compared.
    Ids are numbers, or strings (the smallest by their order). Other columns are ignored, an empty table gives none.
    Tables on the way are written ``under`` a name if one is given, for the caller to discard once the result is read.
    """
    if percent < LEAST:
        raise ValueError(f"the bands find similarities of {LEAST} per cent and more")
    if not integral(docs, id_col):
        base, ids = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
        found = classes(base.select(F.col("_n").alias("doc_id"), "text"), percent=percent, under=under)
        name = lambda c: ids.select(F.col("_n").alias(c), F.col("_id").alias(f"{c}_"))
        found = found.join(name("doc_id"), "doc_id", "left").join(name("component_id"), "component_id", "left")
        return found.select(F.col("doc_id_").alias("doc_id"), "n_shingles", F.col("component_id_").alias("component_id"), "kept")
    rows = written(sketch(docs, id_col, text_col), "sketch", under)
    full = rows.where("n > 0 and doc_id is not null")
    first = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min_by("n", "doc_id").alias("n"), F.min_by("regs", "doc_id").alias("regs"))
    reps = written(first, "representatives", under)
    bands = _bands(reps)
    stars = bands.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("l"), F.count("*").alias("size")).where("size > 1")
    members = written(bands.join(stars.select("key", F.col("l.doc").alias("leader"), F.col("l.n").alias("ln")), "key"), "bands", under)
    pairs = members.where("doc <> leader").where(_close(percent)).select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    crowd = members.select("doc").distinct()
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    texts = source.join(crowd, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")) if _repeats(rows) else source.join(crowd, "doc", "left_semi")
    texts = written(texts, "texts", under)
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    done = written(nearest, "nearest", under)
    label = components(_verified(_estimated(done, reps, percent), texts, percent), under=under)
    rest = written(_other_stars(pairs.join(done, ["a", "b"], "left_anti"), label), "stars", under)
    done = done.unionByName(rest)
    label = _more(label, _verified(_estimated(rest, reps, percent), texts, percent), under)
    mixed = written(_mixed_bands(members, label), "mixed", under)
    rest = written(_small_pairs(mixed, percent).join(done, ["a", "b"], "left_anti"), "pairs", under)
    found = _verified(_estimated(rest, reps, percent), texts, percent).unionByName(_joined_blocks(mixed, texts, percent))
    label = _more(label, found, under)
    known = reps.select("s1", "s2", "doc_id").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = known.select("s1", "s2", F.coalesce("component", "doc_id").alias("component_id"))
    linked = full.select("doc_id", "n", "s1", "s2").join(known, ["s1", "s2"]).select("doc_id", "n", "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _repeats(rows: DataFrame) -> bool:
    return rows.agg(F.count("doc_id") - F.count_distinct("doc_id")).first()[0] > 0


def _more(label: DataFrame, found: DataFrame, under: str | None) -> DataFrame:
    """The components after more links: only those between old components, which these contract, are walked."""
    found = written(found.distinct(), "links", under)
    if found.isEmpty():
        return label
    name = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = found.join(name("a"), "a", "left").join(name("b"), "b", "left")
    upper = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), under=under)
    top = upper.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = label.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(old.unionByName(upper.join(label.select("node"), "node", "left_anti")), "components", under)


def _other_stars(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs of all stars whose ends lie in different components."""
    name = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    out = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left")
    return out.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _mixed_bands(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, doc, n, label, size): the bands that still hold several components; within one there is nothing to find."""
    named = members.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("label"))
    split = named.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed"), F.count("*").alias("size")).where("mixed").select("key", "size")
    return named.join(split, "key")


def _small_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """The pairs across components of bands of SMALL members at most: fewer than SMALL a member."""
    left = mixed.where(F.col("size") <= SMALL).select("key", "doc", "n", "label")
    other = left.select("key", F.col("doc").alias("d2"), F.col("n").alias("ln"), F.col("label").alias("l2"))
    return left.join(other, "key").where("doc < d2 and label <> l2").where(_close(percent)).select(F.col("doc").alias("a"), F.col("d2").alias("b")).distinct()


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, as products of their incidence matrices."""
    values = np.concatenate([*a, *b])
    _, column = np.unique(values, return_inverse=True)
    n = sum(map(len, a))
    row = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    column = column[:n], column[n:]
    top = int(max(column[0].max(initial=-1), column[1].max(initial=-1))) + 1
    out = np.zeros((len(a), len(b)), np.float32)
    order = [np.argsort(c, kind="stable") for c in column]
    row, column = [r[o] for r, o in zip(row, order, strict=True)], [c[o] for c, o in zip(column, order, strict=True)]
    for lo in range(0, top, 4096):
        part = []
        for r, c, m in zip(row, column, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(c, (lo, lo + 4096))
            x = np.zeros((m, min(4096, top - lo)), np.float32)
            x[r[i:j], c[i:j] - lo] = 1
            part.append(x)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _joined_blocks(mixed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within the larger bands.

    A band is cut into blocks of members; each pair of blocks compares its full sets by a matrix product where it is
    held, and gives only as many links as join components, not one a pair.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sets = list(shingle_sets(list(pdf["text"])))
        left = np.flatnonzero(pdf["block"] == i)
        right = np.flatnonzero(pdf["block"] == j)
        ids, labels = pdf["doc"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return none
        both = intersections([sets[k] for k in left], [sets[k] for k in right])
        sizes = np.array([len(s) for s in sets])
        near = (100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)) & (labels[left][:, None] != labels[right][None, :])
        x, y = np.nonzero(near)
        if not len(x):
            return none
        a, b = left[x], right[y]
        _, first = np.unique(np.stack([np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])]), axis=1, return_index=True)
        parent: dict[int, int] = {}

        def root(v):
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        out = []
        for k in first:
            p, q = root(int(labels[a[k]])), root(int(labels[b[k]]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((min(ids[a[k]], ids[b[k]]), max(ids[a[k]], ids[b[k]])))
        return pd.DataFrame(out, columns=["a", "b"])

    large = mixed.where(F.col("size") > SMALL).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    large = large.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks")).join(texts, "doc")
    large = large.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = large.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "doc", "label", "text")
    return large.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with one of each group left, that of the smallest id; of rows that repeat an id, the first text."""
    under = f"near-{uuid.uuid4().hex}"
    found = written(classes(docs, id_col=id_col, text_col=text_col, percent=percent, under=under), "classes")
    discard(docs.sparkSession, under)
    own, names = apart(docs)
    id_, text = names[id_col], names[text_col]
    gone = found.where("not kept").select(F.col("doc_id").alias(id_)).distinct()
    out = own.join(gone, id_, "left_anti")
    if _repeats(found):
        order = Window.partitionBy(id_).orderBy(text)
        out = out.withColumn("row", F.row_number().over(order)).where((F.col("row") == 1) | F.col(id_).isNull())
    return together(out, names)


__all__ = ["WORDS", "classes", "keep_first", "registers", "sketch"]
