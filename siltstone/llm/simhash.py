"""SimHash near-deduplication: fingerprints of word shingles, compared exactly in tiles by exclusive-or and bit counts.

A fingerprint's cell is the population counts of its SEGMENTS equal parts. Two fingerprints can only be within the radius
if their counts differ by no more than that, summed over the parts; pairs of tiles whose counts differ more are skipped,
that is, never brought together. A tile holds the fingerprints of one cell, cut to TILE at most.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components, integral, numbered, written

BITS, WORDS, SEED, RADIUS = 64, 3, 42, 2
#: Parts of a fingerprint whose population counts place it; more parts skip more pairs and send a fingerprint to more
#: tiles. Four hold to some 10**8 distinct fingerprints, eight beyond. Results don't depend on it.
SEGMENTS = 4
#: Fingerprints of a tile, and of the fingerprints of other tiles that one task compares with it.
TILE, VISITORS = 16_384, 131_072
#: Bytes of text whose words are held at once, shingles that are hashed at once, rows and columns of one product.
SLICE, SHINGLES = 1 << 20, 1 << 16
ROWS, COLUMNS = 512, 4096
_GAP = re.compile(rb"[ \t-\r]")


def _shingles(raw: bytes, words: int):
    """The shingles of a text, in lists; words of one slice are held at a time."""
    at, last, whole = 0, [], True
    while at < len(raw):
        gap = _GAP.search(raw, at + SLICE)
        end = gap.start() if gap else len(raw)
        held = last + raw[at:end].split()
        at = end
        if len(held) < words:
            last = held
            continue
        whole = False
        last = held[len(held) - words + 1 :]
        joined = b" ".join(held)
        ends = list(itertools.accumulate(len(w) + 1 for w in held))
        starts = [0, *ends]
        for lo in range(0, len(held) - words + 1, SHINGLES):
            yield [joined[a : b - 1] for a, b in zip(starts[lo : min(lo + SHINGLES, len(held) - words + 1)], ends[lo + words - 1 :], strict=False)]
    if whole and last:
        yield [b" ".join(last)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit i is set if bit i is in more than half of the shingles' hashes, repeats included; 0 without words."""
    count, total = np.zeros(BITS, np.int64), 0
    for part in _shingles((text or "").encode().lower(), words):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        total += len(part)
        count += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row a document row."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, words) for t in text), np.uint64, len(text)).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def _base(segments: int, radius: int) -> int:
    return BITS // segments + 1 + 2 * radius


def cell(fp: Column, segments: int = SEGMENTS, radius: int = RADIUS) -> Column:
    """The population counts of the parts, as digits; a step of up to ``radius`` in one digit never reaches the next."""
    width, out = BITS // segments, F.lit(0).cast("long")
    for i in range(segments):
        part = F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1)) if segments > 1 else fp
        out += (F.bit_count(part) + radius) * F.lit(_base(segments, radius) ** i).cast("long")
    return out


def steps(segments: int, radius: int) -> list[int]:
    """The steps to cells within the radius, one of each two opposite ones."""
    base, found = _base(segments, radius), {0}
    for _ in range(radius):
        found |= {f + sign * base**i for f in found for i in range(segments) for sign in (1, -1)}
    return sorted(f for f in found if f > 0)


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars with the same components as the edges u, v over 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for x in (u, v, label[u], label[v]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(n))
    return label[rest], rest


def near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what is within the radius of x and y: all pairs of a sparse product, stars of a dense one.
    A negative second index -1 - i is x's i."""
    left, right = [], []
    for i, j in itertools.product(range(0, len(x), ROWS), range(0, len(y), COLUMNS)):
        a, b = x[i : i + ROWS], y[j : j + COLUMNS]
        p, q = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        if len(p) > len(a) + len(b):
            p, q = _forest(p, q + len(a), len(a) + len(b))  # the root of a star is one of x; a negative end is one of x too
            q = np.where(q < len(a), -1 - (q + i), q - len(a) + j)
        else:
            q = q + j
        left.append(p + i), right.append(q)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


class _Tile:
    """The residents of one tile; those that come later, and visitors, are compared with those held."""

    def __init__(self, radius: int):
        self.radius, self.fp, self.doc, self.links = radius, np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def _link(self, fp: np.ndarray, doc: np.ndarray, held: np.ndarray, names: np.ndarray) -> None:
        p, q = near(fp, held, self.radius)
        other = q < 0
        a, b = doc[p], np.where(other, doc[np.where(other, -1 - q, 0)], names[np.where(other, 0, q)])
        if (some := a != b).any():
            self.links.append(np.stack([a[some], b[some]]))

    def add(self, fp: np.ndarray, doc: np.ndarray, home: np.ndarray) -> None:
        guests = ~home
        if home.any():
            self.fp, self.doc = np.concatenate([self.fp, fp[home]]), np.concatenate([self.doc, doc[home]])
            self._link(fp[home], doc[home], self.fp, self.doc)
        if guests.any() and len(self.fp):
            self._link(fp[guests], doc[guests], self.fp, self.doc)

    def edges(self) -> np.ndarray:
        """Links (2, m): no more than there are fingerprints in them."""
        if not self.links:
            return np.zeros((2, 0), np.int64)
        names, ends = np.unique(np.concatenate(self.links, axis=1), return_inverse=True)
        ends = ends.reshape(2, -1)
        return names[np.stack(_forest(ends[0], ends[1], len(names)))]


def _compare(radius: int):
    """Walks rows sorted by tile, residents first, and gives each tile's links."""

    def run(batches):
        key, tile = None, None
        for batch in batches:
            d, t, c, home, fp, doc = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("d", "t", "c", "home", "fp", "doc"))
            if not len(d):
                continue
            cut = np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (c[1:] != c[:-1])) + 1
            out = []
            for lo, hi in zip([0, *cut], [*cut, len(d)], strict=True):
                if key != (now := (d[lo], t[lo], c[lo])):
                    if tile:
                        out.append(tile.edges())
                    key, tile = now, _Tile(radius)
                tile.add(fp[lo:hi].view(np.uint64), doc[lo:hi], home[lo:hi].astype(bool))
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(out, axis=1))), ["a", "b"])
        if tile:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, tile.edges())), ["a", "b"])

    return run


def links(reps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between the docs of ``reps(fp, doc)``, distinct fingerprints, that connect all within the radius.

    The counts of cells tell into how many tiles each is cut (t) and into how many parts its visitors are dealt (c).
    """
    placed = reps.select("fp", "doc", cell(F.col("fp"), segments, radius).alias("cell"))
    cells = written(placed.groupBy("cell").agg(F.count("*").alias("m")), "cells")
    reach = cells.select("cell", "m", F.explode(F.array(*[F.lit(s).cast("long") for s in steps(segments, radius)])).alias("step"))
    reach = reach.select("cell", (F.col("cell") + F.col("step")).alias("d"), "m").join(cells.select(F.col("cell").alias("d"), F.col("m").alias("residents")), "d")
    reach = reach.unionByName(cells.select("cell", F.col("cell").alias("d"), "m", F.col("m").alias("residents")))
    load = reach.groupBy("d").agg(F.ceil(F.sum("m") / VISITORS).alias("parts"))
    tiles = F.ceil(F.col("residents") / TILE)
    targets = reach.join(load, "d").groupBy("cell").agg(F.collect_list(F.struct("d", tiles.alias("tiles"), "parts", (F.col("d") == F.col("cell")).alias("own"))).alias("to"))
    sent = placed.join(targets, "cell").select("fp", "doc", F.explode("to").alias("to"))
    mine, part = F.pmod(F.xxhash64("fp"), "to.tiles"), F.pmod(F.xxhash64("doc"), "to.parts")
    ahead = F.col("to.own")
    # A resident is in all parts of its own tile; elsewhere a fingerprint visits one part of each tile, in its own cell of those before its own.
    home = sent.where(ahead).select("fp", "doc", F.col("to.d").alias("d"), mine.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("to.parts") - 1)).alias("c"), F.lit(True).alias("home"))
    until = F.when(ahead, mine).otherwise(F.col("to.tiles"))
    guests = sent.where(until > 0).select("fp", "doc", F.col("to.d").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), until - 1)).alias("t"), part.alias("c"), F.lit(False).alias("home"))
    rows = home.unionByName(guests).repartition("d", "t", "c").sortWithinPartitions("d", "t", "c", F.desc("home"))
    return rows.mapInArrow(_compare(radius), "a long, b long")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Per document row: doc_id, fp (long), component_id: the smallest id reachable over links of ``radius`` bits or fewer.

    Equal fingerprints meet by aggregation and go on as one row. Texts without words, null ones among them, share the
    fingerprint 0 and are linked like any other. A null id has a null component and links nothing. Rows that repeat an
    id share a component, each gives a row; all their texts count. Ids are numbers, or strings (the smallest by their
    order). Other columns are ignored, an empty table gives none.
    """
    if not integral(docs, id_col):
        base, ids = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
        found = classes(base.select(F.col("_n").alias("doc_id"), "text"), words=words, radius=radius, segments=segments)
        name = lambda c: ids.select(F.col("_n").alias(c), F.col("_id").alias(f"{c}_"))
        found = found.join(name("doc_id"), "doc_id", "left").join(name("component_id"), "component_id", "left")
        return found.select(F.col("doc_id_").alias("doc_id"), "fp", F.col("component_id_").alias("component_id"))
    rows = written(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words=words), "fingerprints")
    known = rows.where("doc_id is not null")
    reps = written(known.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    # Rows of one id with several fingerprints are one document: its fingerprints' representatives are linked.
    several = known.join(reps, "fp").groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b")
    several = known.join(several.select("doc_id", "a"), "doc_id").join(reps, "fp").select("a", F.col("doc").alias("b")).where("a <> b")
    found = links(reps, radius, segments)
    label = components(found.unionByName(several) if _repeats(known) else found)
    named = reps.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("fp", F.coalesce("component", "doc").alias("component_id"))
    out = known.join(named, "fp").select("doc_id", "fp", "component_id")
    return out.unionByName(rows.where("doc_id is null").select("doc_id", "fp", F.col("doc_id").alias("component_id")))


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id").count().where("count > 1").isEmpty()


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
