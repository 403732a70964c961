"""Rank and score fusion over hits (query_id, channel, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RRF_K = 60
_CHANNEL = ["query_id", "channel"]


def with_ranks(hits: DataFrame, depth: int | dict[str, int] | None = None) -> DataFrame:
    """Rank from 1 within each query and channel; optionally as deep as the channel may go."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*_CHANNEL).orderBy(F.desc("score"), "doc_id")).cast("long"))
    if isinstance(depth, int):
        return out.where(F.col("rank") <= depth)
    if depth:
        most = F.element_at(F.create_map(*[F.lit(x) for kv in depth.items() for x in kv]), F.col("channel"))
        return out.where(F.col("rank") <= F.coalesce(most, F.lit(0)))
    return out


def keep_first(hits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key once, where it comes first."""
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def min_max(score: Column, by: list[str], constant: float = 0.0) -> Column:
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(constant)


def z_score(score: Column, by: list[str]) -> Column:
    """By the population's deviation; 0 where that is 0."""
    w = Window.partitionBy(*by)
    s = F.stddev_pop(score).over(w)
    return F.when(s > 0, (score - F.avg(score).over(w)) / s).otherwise(0.0)


def softmax(score: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def margin(hits: DataFrame) -> DataFrame:
    """Best minus second score of each query; null with less than two hits."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = hits.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return best.groupBy("query_id").agg((F.max(F.when(F.col("r") == 1, F.col("score"))) - F.max(F.when(F.col("r") == 2, F.col("score")))).alias("margin"))


def rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (query_id, doc_id, score, channels)."""
    return hits.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.sort_array(F.collect_set("channel")).alias("channels"))


def _weight(weights: dict[str, float], default: float) -> Column:
    if not weights:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))]), F.col("channel")), F.lit(default))


def weighted_rrf(hits: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """A channel of weight 0 is skipped, an unknown one weighs 1."""
    w = _weight(weights, 1.0)
    out = hits.withColumn("w", w).where("w <> 0")
    return out.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_list(F.struct("channel", "rank", "score"))).alias("contributions"))


def pooled(hits: DataFrame, weights: dict[str, float], norm: str = "minmax") -> DataFrame:
    """Sum of normalised scores by the channels' shares of all configured weights; unknown channels count nothing."""
    weights = {c: max(0.0, w) for c, w in weights.items()}
    total = sum(weights.values()) or 1.0
    n = min_max(F.col("score"), _CHANNEL, 1.0) if norm == "minmax" else softmax(F.col("score"), _CHANNEL)
    return hits.withColumn("n", n).withColumn("w", _weight({c: w / total for c, w in weights.items()}, 0.0)).groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("w")).alias("score"))


def best_raw(hits: DataFrame) -> DataFrame:
    """Each document by its largest raw score and that score's channel."""
    return hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.max_by("channel", F.struct("score", "channel")).alias("channel"))


def recency(hits: DataFrame, ages: DataFrame, *, max_boost: float = 0.15, half_life: float = 30.0) -> DataFrame:
    """score (1 + max_boost 0.5^(age / half_life)) by ``ages(doc_id, age_days)``; no re-sort, no boost without an age."""
    from siltstone.functions.text import decayed

    out = hits.join(ages, "doc_id", "left")
    return out.withColumn("score", F.col("score") * (1 + max_boost * F.when(F.col("age_days").isNotNull(), decayed(F.greatest("age_days", F.lit(0.0)), half_life)).otherwise(0.0))).drop("age_days")


def concept_boost(hits: DataFrame, concepts: Column, linked: Column, wanted: Column, direct: float = 0.08, one_hop: float = 0.04) -> DataFrame:
    """Adds a bonus where a document's concepts, or else their neighbours, meet the query's."""
    bonus = F.when(F.arrays_overlap(concepts, wanted), direct).when(F.arrays_overlap(linked, wanted), one_hop).otherwise(0.0)
    return hits.withColumn("score", F.col("score") + bonus)


def gated(hits: DataFrame, channel: str, least: float) -> DataFrame:
    """Drops a channel of a query whose best score is below a threshold."""
    best = F.max("score").over(Window.partitionBy(*_CHANNEL))
    return hits.withColumn("b", best).where((F.col("channel") != channel) | (F.col("b") >= least)).drop("b")


def reordered(original: DataFrame, new: DataFrame) -> DataFrame:
    """Reranked documents first in their new order, the rest after them in the old one: (query_id, doc_id, position)."""
    both = original.select("query_id", "doc_id", F.col("rank").alias("old")).join(new.select("query_id", "doc_id", F.col("rank").alias("new")), ["query_id", "doc_id"], "full")
    order = Window.partitionBy("query_id").orderBy(F.col("new").asc_nulls_last(), F.col("old").asc_nulls_last(), "doc_id")
    return both.withColumn("position", F.row_number().over(order).cast("long"))


def moved(positions: DataFrame) -> DataFrame:
    """How many documents of each query changed place."""
    return positions.groupBy("query_id").agg(F.count_if(~F.col("old").eqNullSafe(F.col("position"))).alias("n_moved"))
