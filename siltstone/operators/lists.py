"""Inverted lists of vectors: search with probes, under filters, over product-quantised codes; recall by probes.

An index is a table (cell, doc_id, v), each vector in the list of its nearest centroid. A search deals the lists into
shards of about VECTORS vectors and the queries into blocks of QUERIES; each pair is a matrix product that keeps k rows a
query, however many lists of the shard the query reads.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.operators.vector import QUERIES, ROWS, VECTORS, ranked
from siltstone.sources.tables import checkpoint_root

#: Most inverted lists, whose centroids and sizes every task holds; beyond that lists grow and fill more shards.
LISTS = 4096
#: Vectors of the bounded sample on which centroids and codebooks are fitted.
SAMPLE = 10_000
#: Share of the lists that a query reads by default.
READ = 0.75
#: Codes of a sub-space, so that one byte holds one.
CODES = 256
#: Rows whose distances to all lists are held at a time: 8 MB at most.
STEP = 256
_FOUND = "query_id long, doc_id long, score double"


def _means(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of k-means from n rows drawn at random."""
    if not len(x):
        return x
    c = x[rng.permutation(len(x))[: min(n, len(x))]].astype(float).copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
    return c


def sampled(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The vectors of at most ``sample`` rows, the first by hashed id."""
    n, space = vectors.count(), 1 << 30
    h = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    few = vectors.where("size(v) > 0").where(h < min(space, space * (2 * sample + 64) // max(n, 1)))
    rows = few.orderBy(h, "doc_id").limit(sample).select("v").collect()
    return np.array([r.v for r in rows], float) if rows else np.zeros((0, 0))


def _best(ids: np.ndarray, scores: np.ndarray, queries: pd.Series, k: int) -> list[pd.DataFrame]:
    """The k best of each row of scores, ties to the smaller id; not the query's own, nor -inf."""
    out = []
    for query, s in zip(queries, scores, strict=True):
        s = np.where(ids == query, -np.inf, s)
        least = np.partition(s, max(len(s) - k, 0))[max(len(s) - k, 0)]
        near = np.flatnonzero((s >= least) & (s > -np.inf))
        best = near[np.lexsort((ids[near], -s[near]))[:k]]
        out.append(pd.DataFrame({"query_id": query, "doc_id": ids[best], "score": s[best]}))
    return out


class Ivf:
    """Inverted lists around centroids that k-means fits on a bounded sample."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, float)

    @classmethod
    def fit(cls, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 8, seed: int = 7) -> Ivf:
        """By default as many lists as the root of the number of vectors, LISTS at most."""
        n = lists or min(LISTS, max(1, math.isqrt(vectors.count())))
        return cls(_means(sampled(vectors, sample), n, rounds, np.random.default_rng(seed)))

    @classmethod
    def given(cls, vectors: DataFrame) -> tuple[Ivf, DataFrame]:
        """Lists that ``vectors(doc_id, v, list)`` name, LISTS at most, around the means of their vectors, and their index."""
        means = vectors.where("list is not null").select("list", F.posexplode("v").alias("i", "x")).groupBy("list", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        rows = means.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("list", "c.x").orderBy("list").limit(LISTS + 1).collect()
        if len(rows) > LISTS:
            raise ValueError(f"more than {LISTS} lists")
        names = vectors.sparkSession.createDataFrame([(r["list"], k) for k, r in enumerate(rows)], f"list {vectors.schema['list'].dataType.simpleString()}, cell long")
        return cls(np.array([r.x for r in rows])), vectors.join(F.broadcast(names), "list").select("cell", "doc_id", "v")

    def order(self, x: np.ndarray) -> np.ndarray:
        """All lists, the nearest first, for each row."""
        return np.argsort(self.distances(x), 1, kind="stable")

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest list of each row, some rows at a time: a batch by all lists would be hundreds of MB."""
        parts = [self.distances(x[lo : lo + STEP]).argmin(1) for lo in range(0, len(x), STEP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all lists, less the row's own square."""
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T

    def probes(self) -> int:
        return math.ceil(READ * len(self.centroids))

    def index(self, vectors: DataFrame) -> DataFrame:
        """(cell, doc_id, v): each of ``vectors(doc_id, v)`` in the list of its nearest centroid. Written once, to the
        folder of checkpoints, so that sizes and searches read the same lists. Null and empty vectors have none."""
        shared = vectors.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(cell=shared.value.nearest(np.stack(pdf["v"].to_numpy()).astype(float)))[["cell", "doc_id", "v"]]

        checkpoint_root(vectors.sparkSession)
        rows = vectors.select(F.col("doc_id").cast("long"), F.col("v").cast("array<float>")).where("size(v) > 0")
        return rows.mapInPandas(run, "cell long, doc_id long, v array<float>").checkpoint()

    def asked(self, queries: DataFrame, sizes: dict[int, int], probes: int, least: int = 0) -> DataFrame:
        """(query_id, q, cells, n_read): the lists that each query reads, and how many vectors these hold.

        A query reads its ``probes`` nearest lists, and further ones until they hold ``least`` vectors: as the sizes of
        all lists are known, it widens in one step, not by asking again.
        """
        shared = queries.sparkSession.sparkContext.broadcast((self, np.array([sizes.get(c, 0) for c in range(len(self.centroids))], np.int64)))

        def run(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), STEP):
                    part, (lists, held) = pdf.iloc[lo : lo + STEP], shared.value
                    near = lists.order(np.stack(part["q"].to_numpy()).astype(float))
                    total = np.cumsum(held[near], 1)
                    if not near.shape[1]:
                        yield part.assign(cells=[np.zeros(0, np.int32)] * len(part), n_read=0)
                        continue
                    n = np.minimum(np.maximum((total < least).sum(1) + 1, probes), near.shape[1])
                    cells = [row[:m].astype(np.int32) for row, m in zip(near, n, strict=True)]
                    yield part.assign(cells=cells, n_read=total[np.arange(len(n)), n - 1])

        rows = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<float>")).where("size(q) > 0")
        return rows.mapInPandas(run, "query_id long, q array<float>, cells array<int>, n_read long")

    def search(self, index: DataFrame, queries: DataFrame, k: int, probes: int | None = None, least: int = 0) -> DataFrame:
        """The k largest inner products (6 places) in the lists that a query reads: (query_id, doc_id, score, rank)."""

        def score(group: pd.DataFrame):
            x = np.stack(group["v"].to_numpy()).astype(float)
            return lambda q, use: np.round(q @ x[use].T, 6)

        return ranked(self._meet(index.select("cell", "doc_id", "v"), queries, k, probes, least, score), k)

    def _meet(self, index: DataFrame, queries: DataFrame, k: int, probes: int | None, least: int, scorer) -> DataFrame:
        sizes = {r.cell: r.n for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
        if not sizes:
            return index.sparkSession.createDataFrame([], _FOUND)
        asked = self.asked(queries, sizes, probes or self.probes(), least)
        spark = index.sparkSession
        shards = spark.createDataFrame(_shards(sizes), "cell long, shard long, pieces long")
        blocks = max(1, -(-queries.count() // QUERIES))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        left = index.join(F.broadcast(shards), "cell")
        left = left.select(*index.columns, (F.col("shard") + F.pmod(F.xxhash64("doc_id"), "pieces")).alias("shard"), each(F.lit(blocks).cast("long")).alias("block"))
        where: dict[int, list[int]] = {}
        for cell, shard, pieces in _shards(sizes):
            where[cell] = list(range(shard, shard + pieces))
        shared = spark.sparkContext.broadcast(where)

        def deal(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), STEP):
                    rows = []
                    for r in pdf.iloc[lo : lo + STEP].itertuples(index=False):
                        mine: dict[int, list[int]] = {}
                        for c in r.cells:
                            for s in shared.value.get(int(c), ()):
                                mine.setdefault(s, []).append(int(c))
                        rows += [(r.query_id, r.q, s, np.array(cells, np.int32)) for s, cells in mine.items()]
                    yield pd.DataFrame(rows, columns=["query_id", "q", "shard", "cells"])

        right = asked.mapInPandas(deal, "query_id long, q array<float>, shard long, cells array<int>").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

        def nearest(group: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
            if len(group) and len(part):
                ids = group["doc_id"].to_numpy()
                local, at = np.unique(group["cell"].to_numpy(), return_inverse=True)
                score = scorer(group)
                for lo in range(0, len(part), ROWS):
                    some = part.iloc[lo : lo + ROWS]
                    reads = np.stack([np.isin(local, c) for c in some["cells"]])
                    use = np.flatnonzero(reads.any(0)[at])
                    s = np.where(reads[:, at[use]], score(np.stack(some["q"].to_numpy()).astype(float), use), -np.inf)
                    out += _best(ids[use], s, some["query_id"], k)
            return pd.concat(out)

        groups = ["shard", "block"]
        return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(nearest, _FOUND)


def _shards(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(cell, first shard, pieces): small lists share a shard, a list of over VECTORS is cut into pieces of its own."""
    out, shard, held = [], 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if n > VECTORS:
            if held:
                shard += 1
            pieces = -(-n // VECTORS)
            out.append((cell, shard, pieces))
            shard, held = shard + pieces, 0
            continue
        if held + n > VECTORS:
            shard, held = shard + 1, 0
        out.append((cell, shard, 1))
        held += n
    return out


def filtered_search(lists: Ivf, index: DataFrame, queries: DataFrame, allowed: DataFrame, k: int, *, probes: int | None = None, multiplier: int = 2, most: int = 1000) -> DataFrame:
    """The k nearest of the vectors that ``allowed(doc_id)`` names: (query_id, doc_id, score, rank, n_lists, n_read).

    The filter goes into the lists: only allowed vectors stay in them, and are counted. A query fans out to ``multiplier``
    times k allowed vectors, at most ``most`` and at least k: it reads its ``probes`` nearest lists, and widens to
    further ones until they hold that many, so k hits are found wherever k allowed vectors are. n_lists and n_read tell
    how far it went. A repeated id in ``allowed`` counts once, a null one not; without any, there are no rows.
    """
    marked = index.join(allowed.select(F.col("doc_id").cast("long")), "doc_id", "left_semi").select("cell", "doc_id", "v")
    checkpoint_root(index.sparkSession)
    marked = marked.checkpoint()
    least = fan_out(k, multiplier, most) + 1  # a query may be among the allowed, but is no hit of its own
    found = lists.search(marked, queries, k, probes, least)
    sizes = {r.cell: r.n for r in marked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    reach = lists.asked(queries, sizes, probes or lists.probes(), least).select("query_id", F.size("cells").cast("long").alias("n_lists"), "n_read")
    return found.join(reach, "query_id")


def fan_out(k: int, multiplier: int = 2, most: int = 1000) -> int:
    """How many candidates a filtered search looks for: k times a multiplier, within a bound, never under k."""
    return max(k, min(most, k * max(1, multiplier)))


class Pq:
    """Product-quantised lists: what a vector differs from its centroid, by sub-spaces, each as one of 256 codes."""

    def __init__(self, lists: Ivf, books: np.ndarray):
        self.lists, self.books = lists, books

    @classmethod
    def fit(cls, lists: Ivf, vectors: DataFrame, parts: int = 16, sample: int = SAMPLE, rounds: int = 8, seed: int = 11) -> Pq:
        """Codebooks (parts, codes, dims / parts) of a bounded sample. ``parts`` must divide the dimensions."""
        x = sampled(vectors, sample)
        if x.shape[1] % parts:
            raise ValueError(f"{parts} parts don't divide {x.shape[1]} dimensions")
        rest = (x - lists.centroids[lists.nearest(x)]).reshape(len(x), parts, -1)
        rng = np.random.default_rng(seed)
        return cls(lists, np.stack([_means(rest[:, i], CODES, rounds, rng) for i in range(parts)]))

    def codes(self, cells: np.ndarray, x: np.ndarray) -> np.ndarray:
        rest = (x - self.lists.centroids[cells]).reshape(len(x), len(self.books), -1)
        return np.stack([((b * b).sum(1) - 2 * rest[:, i] @ b.T).argmin(1) for i, b in enumerate(self.books)], 1).astype(np.uint8)

    def decoded(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.lists.centroids[cells] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)

    def encode(self, index: DataFrame) -> DataFrame:
        """(cell, doc_id, code): as many bytes a vector as there are parts, beside its id and list."""
        shared = index.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    codes = shared.value.codes(pdf["cell"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(float))
                    yield pd.DataFrame({"cell": pdf["cell"], "doc_id": pdf["doc_id"], "code": [c.tobytes() for c in codes]})

        checkpoint_root(index.sparkSession)
        return index.mapInPandas(run, "cell long, doc_id long, code binary").checkpoint()

    def search(self, coded: DataFrame, queries: DataFrame, k: int, probes: int | None = None, least: int = 0) -> DataFrame:
        """The k largest estimated inner products: a table of each query's products with all codes, summed by code."""
        shared = coded.sparkSession.sparkContext.broadcast(self)

        def score(group: pd.DataFrame):
            pq, cells = shared.value, group["cell"].to_numpy()
            codes = np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), -1)

            def of(q: np.ndarray, use: np.ndarray) -> np.ndarray:
                out = (q @ pq.lists.centroids.T)[:, cells[use]]
                parts = q.reshape(len(q), len(pq.books), -1)
                for i, b in enumerate(pq.books):
                    out += (parts[:, i] @ b.T)[:, codes[use, i]]
                return np.round(out, 6)

            return of

        return ranked(self.lists._meet(coded.select("cell", "doc_id", "code"), queries, k, probes, least, score), k)

    def refined(self, coded: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, *, factor: int = 10, probes: int | None = None) -> DataFrame:
        """``factor`` times k candidates by their codes, ranked anew by the stored ``vectors(doc_id, v)``."""
        from siltstone.operators.vector import reranked

        return reranked(self.search(coded, queries, k * factor, probes), vectors, queries, k, "ip")


def placed(lists: Ivf, index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, cell, at): at which place, from 1, each query reads each list."""
    every = lists.asked(queries, {}, len(lists.centroids))
    return every.select("query_id", F.posexplode("cells").alias("at", "cell")).select("query_id", F.col("cell").cast("long").alias("cell"), (F.col("at") + 1).cast("long").alias("at"))


def recall_curve(places: DataFrame, index: DataFrame, truth: DataFrame) -> DataFrame:
    """(probes, n_found, recall, mean_read) at every number of probes, in one pass.

    ``places(query_id, cell, at)``, ``index(cell, doc_id)``, ``truth(query_id, doc_id)``. A true neighbour is found from as
    many probes on as the place of its list, so counts by place, summed up, give the recall at all of them; the
    vectors read follow likewise from the lists' sizes. A neighbour that no list holds counts as never found.
    """
    sizes = index.groupBy("cell").agg(F.count("*").alias("n"))
    reads = places.join(sizes, "cell", "left").groupBy("at").agg(F.sum(F.coalesce("n", F.lit(0))).alias("read"), F.count_distinct("query_id").alias("queries"))
    hits = truth.join(index.select("doc_id", "cell"), "doc_id").join(places, ["query_id", "cell"]).groupBy("at").agg(F.count("*").alias("hits"))
    total = truth.count()
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # over places: LISTS rows at most
    out = reads.join(hits, "at", "left").select("at", F.sum(F.coalesce("hits", F.lit(0))).over(upto).alias("n_found"), (F.sum("read").over(upto) / F.max("queries").over(upto)).alias("mean_read"))
    return out.select(F.col("at").alias("probes"), "n_found", (F.col("n_found") / F.lit(max(total, 1))).alias("recall"), "mean_read")


def factor_curve(candidates: DataFrame, truth: DataFrame, k: int, factors: list[int]) -> DataFrame:
    """(factor, n_found, recall): how many of the k true neighbours are among the first factor times k candidates."""
    total = truth.count()
    at = candidates.join(truth.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select(F.ceil(F.col("rank") / k).alias("need"))
    need = at.groupBy("need").agg(F.count("*").alias("hits"))
    wanted = need.sparkSession.createDataFrame([(f,) for f in sorted(factors)], "factor long")
    out = wanted.join(need, F.col("need") <= F.col("factor"), "left").groupBy("factor").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("n_found"))
    return out.select("factor", "n_found", (F.col("n_found") / F.lit(max(total, 1))).alias("recall"))


def token_candidates(lists: Ivf, index: DataFrame, tokens: DataFrame, query_tokens: DataFrame, per_token: int, probes: int | None = None) -> DataFrame:
    """Wide search: (query_id, doc_id) of the documents that own one of the ``per_token`` tokens nearest to a query token.

    ``index`` holds ``tokens(token, doc_id)`` under their token ids; ``query_tokens(query_id, token, q)``. A token id is
    unique over all documents, a query's tokens may be tokens of a document.
    """
    asked = query_tokens.select(F.col("token").alias("query_id"), "q")
    near = lists.search(index, asked, per_token, probes).select(F.col("query_id").alias("token"), F.col("doc_id").alias("near"))
    owners = tokens.select(F.col("token").alias("near"), "doc_id")
    return query_tokens.select("query_id", "token").join(near, "token").join(owners, "near").where("query_id <> doc_id").select("query_id", "doc_id").distinct()


def token_rescored(candidates: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, k: int, explain: int = 0) -> DataFrame:
    """Narrow mode: MaxSim over the token matrices of ``candidates(query_id, doc_id)`` only: (query_id, doc_id, score, rank).

    ``query_tokens(query_id, token, q)``, ``doc_tokens(token, doc_id, v)``; a matrix is one row, read where a candidate
    needs it. A document without tokens scores nothing and goes; a repeated candidate counts once. With ``explain``, the
    column ``matches`` holds so many (query token, document token, similarity), the best first.
    """
    pairs = candidates.select("query_id", "doc_id").distinct()
    docs = doc_tokens.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = docs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token", "v"))).alias("d"))
    asked = query_tokens.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "q"))).alias("a"))
    rows = pairs.join(docs, "doc_id").join(asked, "query_id")
    rows = rows.select("query_id", "doc_id", F.col("a.token").alias("at"), F.col("a.q").alias("q"), F.col("d.token").alias("dt"), F.col("d.v").alias("v"))
    match = "struct<query_token:bigint,doc_token:bigint,similarity:double>"

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                s = np.stack(r.q).astype(float) @ np.stack(r.v).astype(float).T
                best, top = s.argmax(1), s.max(1)
                order = np.lexsort((r.at, -top))[:explain]
                matches = [{"query_token": int(r.at[i]), "doc_token": int(r.dt[best[i]]), "similarity": round(float(top[i]), 6)} for i in order]
                out.append((r.query_id, r.doc_id, round(float(top.sum()), 5), matches))
            yield pd.DataFrame(out, columns=["query_id", "doc_id", "score", "matches"])

    scored = ranked(rows.mapInPandas(run, f"query_id long, doc_id long, score double, matches array<{match}>"), k)
    return scored if explain else scored.drop("matches")
