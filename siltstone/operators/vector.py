"""Dense vectors: norms, exact neighbours in blocks, merging of indexes, exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Vectors and, while they are few, queries in one block of an exact search.
VECTORS, QUERIES = 32_768, 2048
#: Queries of a block whose scores are held at a time: 8 MB for the vectors of a block.
ROWS = 32
#: Queries and vectors of an exact search whose scores are held at a time: 8 MB, too.
TILE = 256, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _floor(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row, a number that at least k of its scores reach: the k-th of the largest scores of disjoint sets of columns."""
    sets = min(scores.shape[1], 8 * k)
    if sets < k:
        return np.full(len(scores), -np.inf)
    wide = scores.shape[1] // sets
    most = np.fmax.reduce(scores[:, : wide * sets].reshape(len(scores), wide, sets), 1)
    return np.partition(most, sets - k, axis=1)[:, sets - k]


def _nearest(group: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a block for each query. Scores are made a tile at a time; only those that can be among the k best leave it."""
    kinds = {"query_id": "int64", "doc_id": "int64", "score": "float64"}
    if not len(group) or not len(asked):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})
    group = group.sort_values("doc_id")
    ids, x = group["doc_id"].to_numpy(), np.stack(group["v"].to_numpy()).astype(float)
    out = []
    for lo in range(0, len(asked), TILE[0]):
        part = asked.iloc[lo : lo + TILE[0]]
        own, q = part["query_id"].to_numpy(), np.stack(part["q"].to_numpy()).astype(float)
        row, col, best = np.empty(0, int), np.empty(0, int), np.empty(0)
        least = np.full(len(part), -np.inf)
        for at in range(0, len(x), TILE[1]):
            tile = ids[at : at + TILE[1]]
            scores = q @ x[at : at + TILE[1]].T
            first, last = np.searchsorted(tile, own), np.searchsorted(tile, own, "right")
            for r in np.flatnonzero(last > first):
                scores[r, first[r] : last[r]] = -np.inf
            if np.isneginf(least).any():
                least = np.maximum(least, _floor(scores, k))
            # What is rounded to no less than ``least`` is: up to 5e-7 on either side, and the last digits of large scores.
            slack = 2e-6 + 1e-14 * np.abs(np.where(np.isfinite(least), least, 0.0))
            r, c = np.divmod(np.flatnonzero(scores >= (least - slack)[:, None]), scores.shape[1])
            s = scores[r, c]
            r, c, s = r[s > -np.inf], c[s > -np.inf], np.round(s[s > -np.inf], 6)
            row, col, best = np.concatenate([row, r]), np.concatenate([col, c + at]), np.concatenate([best, s])
            order = np.lexsort((col, -best, row))
            order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
            row, col, best = row[order], col[order], best[order]
            full = np.searchsorted(row, np.arange(len(part)), "right") - 1
            full = full[np.bincount(row, minlength=len(part)) == k]
            least[row[full]] = best[full]
        out.append(pd.DataFrame({"query_id": own[row], "doc_id": ids[col], "score": best}))
    return pd.concat(out).astype(kinds)


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k largest inner products (6 places) of ``vectors(doc_id, v)`` for ``queries(query_id, q)``, not with itself.

    Both sides are cut into blocks of at most VECTORS; each pair of blocks is a matrix product that keeps k rows a query. A
    vector is copied once for each block of queries: that makes a dozen of these, and more only where they'd be too large.
    """
    n, m = vectors.count(), queries.count()
    nv, nq = max(1, math.ceil(n / VECTORS)), max(1, math.ceil(m / min(VECTORS, max(QUERIES, m // 12))))
    left = vectors.select("doc_id", "v", F.pmod(F.xxhash64("doc_id"), F.lit(nv)).alias("i"), _each(nq).alias("j"))
    right = queries.select("query_id", "q", _each(nv).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("j"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda a, b: _nearest(a, b, k), "query_id long, doc_id long, score double")
    return ranked(found, k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def index_family(n: int) -> tuple[str, int]:
    """The family (exact search, ``lists.Ivf``, ``lists.Pq`` over it) and number of lists that suit so many vectors."""
    if n < 5_000:
        return "flat", 0
    if n < 50_000:
        return "ivf_flat", max(math.isqrt(n), 100)
    return "ivf_pq", max(math.isqrt(n), 1024)


def memory_estimate(n: int, dim: int, lists: int, code_bytes: int | None = None) -> int:
    """Bytes of an index: codes or floats, ids and centroids."""
    return n * ((code_bytes or 4 * dim) + 8) + lists * dim * 4


def merged(primary: DataFrame, secondary: DataFrame, k: int) -> DataFrame:
    """Two result lists as one: each id once, by its best score."""
    both = primary.select("query_id", "doc_id", "score").unionByName(secondary.select("query_id", "doc_id", "score"))
    return ranked(both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def reranked(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cos") -> DataFrame:
    """Candidates scored exactly; one without a stored vector keeps the last place instead of going."""
    v = candidates.select("query_id", "doc_id").join(vectors.select("doc_id", "v"), "doc_id", "left").join(queries.select("query_id", "q"), "query_id")
    score = cosine(F.col("q"), F.col("v")) if metric == "cos" else dot(F.col("q"), F.col("v"))
    return ranked(v.select("query_id", "doc_id", F.coalesce(F.round(score, 6), F.lit(-3.4028234663852886e38)).alias("score")), k)


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame, k: int, *, block: int = 4096) -> DataFrame:
    """Late interaction: for (query_id, qt, q) and (doc_id, dt, v), the sum over query tokens of the best inner product.

    Token matrices meet in blocks; a document's tokens stay in one block, so its score is final there.
    """
    docs = max(1, math.ceil(doc_tokens.count() / block))
    asked = max(1, math.ceil(query_tokens.count() / block))
    left = doc_tokens.select("doc_id", "v", F.pmod(F.xxhash64("doc_id"), F.lit(docs)).alias("i"), _each(asked).alias("j"))
    right = query_tokens.select("query_id", "qt", "q", _each(docs).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(asked)).alias("j"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        kinds = {"query_id": "int64", "doc_id": "int64", "score": "float64"}
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})
        a, b = a.sort_values("doc_id"), b.sort_values("query_id")
        s = np.stack(b["q"].to_numpy()).astype(float) @ np.stack(a["v"].to_numpy()).astype(float).T
        ids, first = np.unique(a["doc_id"].to_numpy(), return_index=True)
        qs, qfirst = np.unique(b["query_id"].to_numpy(), return_index=True)
        total = np.add.reduceat(np.maximum.reduceat(s, first, 1), qfirst, 0)
        out = pd.DataFrame({"query_id": np.repeat(qs, len(ids)), "doc_id": np.tile(ids, len(qs)), "score": np.round(total, 5).ravel()})
        out = out[out["query_id"] != out["doc_id"]].sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True])
        return out.groupby("query_id").head(k).astype(kinds)

    return ranked(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(score, "query_id long, doc_id long, score double"), k)
