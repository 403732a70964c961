"""Approximate nearest neighbours by inner product: balanced posting lists, boundary replicas, a graph over centroids.

Vectors are lifted to one norm (the largest inner product then is the smallest distance). Centroids are fitted in two
levels on a bounded sample, so that lists hold about LIST vectors each; every vector is put in the list of its nearest
centroid and, if it lies within SPREAD of the boundary to further ones, in those too. A query searches the graph of
centroids and reads every list within a ratio of its distance to the lists nearest to it. The ratio is the smallest at
which TRIALS queries, compared with all vectors, find the share AIM of their neighbours. Lists that are neighbours by
number travel together as a shard of a bounded size; the queries stream past it, and a task keeps k a query before it
emits anything. Scores are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm.common import written

#: Vectors (and bytes of vectors) that the fit reads at most, and queries of them that set the ratio.
SAMPLE, SAMPLE_BYTES, TRIALS = 32_768, 32 << 20, 200
#: Vectors of a list, and the lists that the centroids, which every worker holds, may make. Beyond LIST * MOST_LISTS
#: vectors lists grow; shards, which bound a task, don't.
LIST, MOST_LISTS = 8, 16_384
COPIES, SPREAD, APART = 3, 1.02, 0.5
AIM = 0.95
#: Neighbours of a centroid in the graph, nearest lists whose mean distance is the unit of the ratio.
DEGREE, UNIT = 16, 32
#: Vectors (and bytes of vectors) of a shard's piece, which a task holds; queries that pass one copy of it, a few at a
#: time, before another task takes more; rows that search the graph at once.
PIECE, PIECE_BYTES, BLOCK, STEP = 8_192, 64 << 20, 65_536, 256
#: Entries of a distance matrix that the fit holds at a time: 8 MB.
CELLS = 1 << 21


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _by_rows(f, x: np.ndarray, width: int) -> np.ndarray:
    """``f`` of a few rows of x at a time, so that a matrix of these rows and ``width`` columns has CELLS entries at most.
    Results are copied: a slice would keep its whole matrix alive."""
    step = max(1, CELLS // max(1, width))
    return np.concatenate([f(x[lo : lo + step]).copy() for lo in range(0, len(x), step)])


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c of each row of x."""
    return _by_rows(lambda part: _squared(part, c).argmin(1), x, len(c))


def _means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """k-means: centroids, and the nearest one of each row. An empty one takes a member of the largest."""
    centre = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = _closest(x, centre)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        full = size > 0
        centre[full] = total[full] / size[full, None]
        if not full.all():
            centre[~full] = x[rng.choice(np.flatnonzero(near == size.argmax()), (~full).sum())]
    return centre, _closest(x, centre)


class Index:
    """Centroids, their graph and the query's distance ratio."""

    def __init__(self, sample: np.ndarray, top: float, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.top = top
        x = self.lift(sample)
        lists = max(1, min(lists, len(x)))
        groups = max(1, math.isqrt(lists) // 4)
        self.centre, near = _means(x, groups, rng)
        some = [x[near == j] for j in range(groups)]
        # as many lists a group as its share of the sample: lists of one size
        fine = [_means(p, min(len(p), max(1, round(lists * len(p) / len(x)))), rng, 4)[0] for p in some if len(p)]
        self.centroids = np.concatenate(fine)
        lists = len(self.centroids)
        first = lambda x, n: _by_rows(lambda part: np.argpartition(_squared(part, self.centroids), min(n, lists) - 1, 1)[:, :n], x, lists)
        self.graph = first(self.centroids, DEGREE + 1)
        self.graph = np.concatenate([self.graph, rng.integers(0, lists, (lists, 4))], 1)  # a few long edges keep it connected
        #: The lists where a search begins that is nearest to a group.
        self.doors = first(self.centre, 4)
        self.ratio = 1.0
        #: Vectors that a query must at least reach, and those of each list; set when the lists are filled.
        self.need, self.held = 0, np.zeros(lists, np.int64)

    def lift(self, v: np.ndarray) -> np.ndarray:
        """At most unit norm, and what is missing to it."""
        v = v / self.top
        return np.concatenate([v, np.sqrt(np.maximum(1 - (v * v).sum(1), 0))[:, None]], 1).astype(np.float32)

    def aim(self, q: np.ndarray) -> np.ndarray:
        """A query at unit norm, with nothing appended."""
        return np.concatenate([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)

    def nearest(self, x: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of the graph: the nearest ``breadth`` centroids found of each row, with distances."""
        parts = [self._nearest(x[lo : lo + STEP], breadth) for lo in range(0, len(x), STEP)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest(self, x: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        n, lists = len(x), len(self.centroids)
        breadth = min(breadth, lists)
        if lists <= 2 * breadth:
            ids = np.broadcast_to(np.arange(lists), (n, lists))
        else:
            group = np.argsort(_squared(x, self.centre), 1)[:, : -(-breadth // self.doors.shape[1])]
            ids = self.doors[group].reshape(n, -1)
        rows = np.arange(n)[:, None]
        dist = self._far(x, ids)
        twin = np.zeros(ids.shape, bool)
        by = np.argsort(ids, 1, kind="stable")
        twin[rows, by[:, 1:]] = np.take_along_axis(ids, by, 1)[:, 1:] == np.take_along_axis(ids, by, 1)[:, :-1]
        dist[twin] = np.inf
        seen = np.zeros((n, lists), bool)
        seen[rows, ids] = True
        open_ = np.isfinite(dist) & (lists > 2 * breadth)
        while True:
            order = np.argsort(dist, 1, kind="stable")[:, :breadth]
            ids, dist, open_ = ids[rows, order], dist[rows, order], open_[rows, order]
            if not open_.any():
                return ids, dist
            first = np.argsort(~open_, 1, kind="stable")[:, :4]
            live = open_[rows, first]
            open_[rows, first] = False
            new = self.graph[ids[rows, first]].reshape(n, -1)
            fresh = np.repeat(live, self.graph.shape[1], 1) & ~seen[rows, new]
            # a centroid that two neighbours share counts once
            by = np.argsort(np.where(fresh, new, -1), 1, kind="stable")
            flat = np.take_along_axis(np.where(fresh, new, -1), by, 1)
            fresh[rows, by[:, 1:]] &= flat[:, 1:] != flat[:, :-1]
            r, c = np.nonzero(fresh)
            seen[r, new[r, c]] = True
            more = np.full(new.shape, np.inf, np.float32)
            more[r, c] = np.linalg.norm(x[r] - self.centroids[new[r, c]], axis=1)
            ids, dist = np.concatenate([ids, new], 1), np.concatenate([dist, more], 1)
            open_ = np.concatenate([open_, np.isfinite(more)], 1)

    def _far(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.stack([np.linalg.norm(self.centroids[i] - row, axis=1) for i, row in zip(ids, x, strict=True)])

    def within(self, x: np.ndarray, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Flood of the graph: a mask (row, list) of the lists no farther than ``far``, from the lists ``ids`` on."""
        rows = np.arange(len(x))[:, None]
        seen, inside = np.zeros((2, len(x), len(self.centroids)), bool)
        seen[rows, ids] = True
        front = ids
        r, c = np.nonzero(self._far(x, ids) <= far[:, None])
        at = ids[r, c]
        while len(r):
            inside[r, at] = True
            front = np.zeros(seen.shape, bool)
            front[np.repeat(r, self.graph.shape[1]), self.graph[at].ravel()] = True
            front &= ~seen
            seen |= front
            found = [(i, own[np.linalg.norm(self.centroids[own] - x[i], axis=1) <= far[i]]) for i in np.flatnonzero(front.any(1)) if len(own := np.flatnonzero(front[i]))]
            r = np.repeat([i for i, _ in found], [len(own) for _, own in found]).astype(np.int64)
            at = np.concatenate([own for _, own in found]) if found else r
        return inside

    def homes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists of each vector. A replica goes to a centroid that is no near twin of an
        earlier home: it lies APART times its distance from it."""
        ids, dist = self.nearest(self.lift(v), max(COPIES, 8))
        ids, dist = ids[:, :COPIES], dist[:, :COPIES]
        own = dist <= SPREAD * dist[:, :1] + 1e-12
        for j in range(1, ids.shape[1]):
            for i in range(j):
                gap = np.linalg.norm(self.centroids[ids[:, i]] - self.centroids[ids[:, j]], axis=1)
                own[:, j] &= ~own[:, i] | (gap > APART * dist[:, j])
        return np.nonzero(own)[0], ids[own]

    def units(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest lists of each row, and their mean distance."""
        ids, dist = self.nearest(x, UNIT)
        return ids, np.maximum(dist.mean(1), 1e-9)

    def lists(self, q: np.ndarray) -> np.ndarray:
        """A mask (query, list) of what each query reads: the lists within the ratio, and with a wider ratio until they
        hold ``need`` vectors."""
        return np.concatenate([self._lists(self.aim(q[lo : lo + STEP])) for lo in range(0, len(q), STEP)])

    def _lists(self, x: np.ndarray) -> np.ndarray:
        ids, unit = self.units(x)
        far = self.ratio * unit
        out = self.within(x, ids, far)
        while len(short := np.flatnonzero(out @ self.held < self.need)):
            far[short] *= 1.1
            out[short] = self.within(x[short], ids[short], far[short])
            whole = short[far[short] > 3]  # two points of unit norm are never so far apart
            out[whole] = True
            if len(whole) == len(short):
                break
        return out

    def calibrate(self, trials: np.ndarray, near: list[np.ndarray]) -> None:
        """The ratio at which ``trials`` find AIM of their true neighbours, the rows of ``near``."""
        need = []
        for q, v in zip(self.aim(trials), near, strict=True):
            if len(v):
                row, home = self.homes(v)
                dist = np.linalg.norm(self.centroids[home] - q, axis=1) / self.units(q[None])[1][0]
                need.append(np.minimum.reduceat(dist, np.searchsorted(row, np.arange(len(v)))))
        self.ratio = float(np.quantile(np.concatenate(need), AIM)) + 1e-6 if need else 1.0


def _best(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, reads, k: int):
    """For each query its k best ids of those rows that it reads, each by its best row, scored exactly; ties to the smaller id.

    ``ids`` are sorted by list, ``reads(lo, hi)`` gives (rows of ids from, to, queries of the part) of each list.
    """
    size = np.linalg.norm(x, axis=1).max(initial=0)
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        rough = np.full((len(part), len(x)), -np.inf)
        for start, stop, rows in reads(lo, lo + len(part)):
            rough[rows, start:stop] = part[rows] @ x[start:stop].T
        slack = 1e-9 * np.linalg.norm(part, axis=1) * size
        for i, query in enumerate(asked[lo : lo + 256]):
            # repeated rows and the query's own may take places: widen until k ids are left, or no more rows
            read = np.flatnonzero(rough[i] > -np.inf)
            own, n = rough[i, read], k + 1
            while True:
                least = np.partition(own, len(own) - n)[len(own) - n] if n < len(own) else -np.inf
                near = read[own >= least - slack[i]]
                near = near[ids[near] != query]
                if n >= len(own) or len(np.unique(ids[near])) >= k:
                    break
                n *= 2
            exact = (x[near] * part[i]).sum(1)
            order = np.lexsort((ids[near], -exact))
            found = ids[near[order]]
            order = order[np.sort(np.unique(found, return_index=True)[1])][:k]
            yield query, ids[near[order]], exact[order]


class _Piece:
    """A piece of a shard in memory: its rows in the order of their lists."""

    def __init__(self, rows: list[pd.DataFrame]):
        rows = pd.concat(rows, ignore_index=True)
        lists, self.ids = rows["list"].to_numpy(np.int64), rows["id"].to_numpy()
        self.x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        self.start = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        self.stop = np.r_[self.start[1:], len(lists)]
        self.lists = lists[self.start]

    def search(self, asked: pd.DataFrame, k: int) -> pd.DataFrame:
        """One row a query: ids and scores of its k best in this piece, among the lists that it reads."""
        q = np.stack(asked["v"].to_numpy()).astype(np.float64)
        wanted = [np.frombuffer(r, np.int32) for r in asked["lists"]]
        row, want = np.repeat(np.arange(len(q)), [len(w) for w in wanted]), np.concatenate(wanted)
        order = np.argsort(want, kind="stable")
        row, want = row[order], want[order]
        edge = np.searchsorted(want, self.lists), np.searchsorted(want, self.lists, "right")

        def reads(lo, hi):
            for a, b, i, j in zip(self.start, self.stop, *edge, strict=True):
                rows = row[i:j]
                rows = rows[(rows >= lo) & (rows < hi)] - lo
                if len(rows):
                    yield a, b, rows

        found = [(i, v, s) for i, v, s in _best(self.ids, self.x, asked["id"].to_numpy(), q, reads, k) if len(v)]
        return pd.DataFrame(found, columns=["query_id", "vec_ids", "scores"])


def _passes(batches, k: int):
    """Pieces one after another, each sorted so that its vectors come first: these are kept, then its queries are
    answered as they come. Only one piece and one batch of queries are held, however many queries there are."""
    at, rows, piece = None, [], None
    for pdf in batches:
        keys = pdf[["shard", "piece", "block", "asks"]].to_numpy(np.int64)
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(pdf) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
            part, key = pdf.iloc[lo:hi], tuple(keys[lo, :3])
            if key != at:
                at, rows, piece = key, [], None
            if not keys[lo, 3]:
                rows.append(part)
            elif rows or piece:
                if rows:
                    piece, rows = _Piece(rows), []
                yield piece.search(part, k)


def _trials(base: DataFrame, trials: pd.DataFrame, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vectors of the trial queries, and of the true k neighbours of each among all of ``base``."""
    q, asked = np.stack(trials["v"].to_numpy()).astype(np.float64), trials["vec_id"].to_numpy()
    shared = base.sparkSession.sparkContext.broadcast((q, asked))

    def run(batches):
        q, asked = shared.value
        kept = [(np.zeros(0), np.zeros((0, q.shape[1])))] * len(q)
        for pdf in batches:
            if len(pdf):
                x, ids = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["vec_id"].to_numpy()
                score = q @ x.T
                score[asked[:, None] == ids] = -np.inf
                best = np.argsort(-score, 1)[:, :k]
                for i, (old, rows) in enumerate(kept):
                    s, v = np.concatenate([old, score[i, best[i]]]), np.concatenate([rows, x[best[i]]])
                    top = np.argsort(-s, kind="stable")[:k]
                    kept[i] = s[top], v[top]
        for i, (s, v) in enumerate(kept):
            if len(s := s[s > -np.inf]):
                yield pd.DataFrame({"trial": i, "score": s, "v": list(v[: len(s)])})

    found = base.mapInPandas(run, "trial int, score double, v array<double>")
    order = Window.partitionBy("trial").orderBy(F.desc("score"))
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("trial", "v").toArrow().to_pandas()
    by = dict(list(found.groupby("trial")["v"]))
    return q, [np.stack(by[i].to_numpy()) if i in by else np.zeros((0, q.shape[1])) for i in range(len(q))]


def fit(base: DataFrame, n: int, dim: int, k: int) -> Index:
    """An index of ``base(vec_id, v)`` of n rows, fitted on a bounded sample that a hash of the id draws."""
    rows = min(SAMPLE, max(500, SAMPLE_BYTES // (8 * dim)))
    top = base.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0]
    space = 1 << 30
    drawn = base.withColumn("h", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(space))).where(F.col("h") < math.ceil(space * rows / n))
    # rows of one id are one: no more than about ``rows`` are left of all
    drawn = drawn.groupBy("vec_id", "h").agg(F.min("v").alias("v")).orderBy("h", "vec_id").limit(rows)
    sample = drawn.select("vec_id", "v").toArrow().to_pandas()
    if not len(sample):
        sample = base.orderBy("vec_id").limit(1).toArrow().to_pandas()
    index = Index(np.stack(sample["v"].to_numpy()).astype(np.float64), top, min(MOST_LISTS, max(8, n // LIST)))
    index.calibrate(*_trials(base, sample.iloc[:TRIALS], k))
    return index


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, report: dict | None = None) -> DataFrame:
    """Per query its k nearest found: query_id, rank, vec_id, score.

    ``queries`` has the same columns; without it, those rows ask whose id is divisible by ``every``. Ids are longs, or
    strings (then ``queries`` must be given). Null, zero and non-finite vectors take no part, nor do null ids, nor
    vectors of another dimension than the most frequent. A repeated id counts once, by its best score; a query is
    never its own neighbour. Other columns are ignored; with no candidates, or none but the query, there are no rows.
    ``report``, if given, receives the share of lists and of vectors that a query reads and the copies of a vector.
    """
    spark = vectors.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    id_type = "string" if kind[id_col] == "string" else "long"
    v_type = "array<float>" if kind[vector_col] == "array<float>" else "array<double>"

    def clean(df, name):
        v = F.col(vector_col).cast(v_type)
        return df.select(F.col(id_col).cast(id_type).alias(name), v.alias("v")).where(usable(F.col("v")) & F.col(name).isNotNull())

    base = clean(vectors, "vec_id")
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    none = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    if sizes is None:
        return spark.createDataFrame([], none)
    dim = sizes.d
    base = base.where(F.size("v") == dim)
    asked = base.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id") if queries is None else clean(queries, "query_id").where(F.size("v") == dim)
    index = fit(base, sizes["count"], dim, k)
    shared = spark.sparkContext.broadcast(index)

    def post(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                row, home = shared.value.homes(np.stack(part["v"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[row], "list": home.astype(np.int32), "v": part["v"].to_numpy()[row]})

    posted = written(base.mapInPandas(post, f"vec_id {id_type}, list int, v {v_type}"), "postings")
    # one row a list: its rows, and the ids that it alone counts, so that lists that hold k and one more hold k others than the query
    held = posted.groupBy("list").agg(F.count("*").alias("rows")).toArrow().to_pandas()
    owned = posted.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").agg(F.count("*").alias("ids")).toArrow().to_pandas()
    index.need = k + 1
    index.held[owned["list"]] = owned["ids"]
    rows = np.zeros(len(index.held), np.int64)
    rows[held["list"]] = held["rows"]
    piece = max(256, min(PIECE, PIECE_BYTES // (8 * dim)))
    shard = ((np.cumsum(rows) - rows) // piece).astype(np.int32)
    pieces = np.maximum(1, -(-np.bincount(shard, rows).astype(np.int64) // piece))
    filled = spark.sparkContext.broadcast((index, shard))

    def ask(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), STEP):
                part = pdf.iloc[lo : lo + STEP]
                index, shard = filled.value
                row, home = np.nonzero(index.lists(np.stack(part["v"].to_numpy()).astype(np.float64)))
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[home[1:]] != shard[home[:-1]])][: len(row)])
                said = np.split(home.astype(np.int32), first[1:])
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row[first]], "shard": shard[home[first]], "lists": [s.tobytes() for s in said], "v": part["v"].to_numpy()[row[first]]})

    reads = written(asked.mapInPandas(ask, f"query_id {id_type}, shard int, lists binary, v {v_type}"), "reads")
    blocks = reads.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).collect()
    # shards are as many as lists at most
    sized = spark.createDataFrame([(r.shard, int(r.blocks), int(pieces[r.shard])) for r in blocks], "shard int, blocks long, pieces long")
    where = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(shard), dtype=np.int32), "shard": shard}), "list int, shard int").join(sized, "shard")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["shard", "piece", "block"]
    left = posted.join(F.broadcast(where), "list").select("shard", F.pmod(F.xxhash64("vec_id"), "pieces").alias("piece"), each("blocks").alias("block"), F.lit(0).alias("asks"), "list", F.col("vec_id").alias("id"), F.lit(b"").alias("lists"), "v")
    right = reads.join(F.broadcast(sized), "shard").select("shard", each("pieces").alias("piece"), F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), F.lit(1).alias("asks"), F.lit(-1).alias("list"), F.col("query_id").alias("id"), "lists", "v")
    met = left.union(right).repartition(*keys).sortWithinPartitions(*keys, "asks", "list", "id")
    found = met.mapInPandas(lambda batches: _passes(batches, k), f"query_id {id_type}, vec_ids array<{id_type}>, scores array<double>")
    if report is not None:
        read = reads.agg(F.sum(F.octet_length("lists") / 4).alias("lists"), F.count_distinct("query_id").alias("n")).first()
        report |= {"lists": len(shard), "copies": rows.sum() / sizes["count"], "ratio": index.ratio, "share": (read["lists"] or 0) / max(1, (read.n or 0) * len(shard))}
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id may come from several lists and rows: it is made one before the first k are taken
    found = found.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).groupBy("query_id", F.col("x.vec_ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
