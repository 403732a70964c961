"""Retrieval evaluation: recall, hit rate, reciprocal rank, coverage, percentiles, drift and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def per_query(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, n_relevant, found, hit, rr) of hits(query_id, doc_id, rank from 1) and relevant(query_id, doc_id)."""
    good = relevant.select("query_id", "doc_id").distinct()
    size = good.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    found = hits.where(F.col("rank") <= k).join(good, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count_distinct("doc_id").alias("found"), F.max(1.0 / F.col("rank")).alias("rr"))
    out = size.join(found, "query_id", "left")
    return out.select("query_id", "n_relevant", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) > 0).alias("hit"), F.coalesce("rr", F.lit(0.0)).alias("rr"))


def per_query_by_label(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``per_query`` where the relevant documents of ``queries(query_id, label)`` are the others of ``docs(doc_id, label)`` with
    its label: counted by label, so that only the ranked hits are joined and no pair of a label is made. Queries and
    documents share their ids; a query without another document of its label has no row."""
    sizes = docs.groupBy("label").agg(F.count("*").alias("n"))
    own = docs.select(F.col("doc_id").alias("query_id"), "label", F.lit(1).alias("own"))
    size = queries.join(sizes, "label").join(own, ["query_id", "label"], "left").select("query_id", "label", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_relevant")).where("n_relevant > 0")
    ranked = hits.where((F.col("rank") <= k) & (F.col("query_id") != F.col("doc_id"))).join(docs, "doc_id").join(size.select("query_id", "label"), ["query_id", "label"])
    found = ranked.groupBy("query_id").agg(F.count_distinct("doc_id").alias("found"), F.max(1.0 / F.col("rank")).alias("rr"))
    out = size.join(found, "query_id", "left")
    return out.select("query_id", "n_relevant", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) > 0).alias("hit"), F.coalesce("rr", F.lit(0.0)).alias("rr"))


def means(scores: DataFrame) -> DataFrame:
    """Recall, hit rate and mean reciprocal rank over queries."""
    return scores.agg(F.count("*").alias("n_queries"), F.avg(F.col("found") / F.col("n_relevant")).alias("recall"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("rr").alias("mrr"))


def overlap(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of approximate hits that the exact ones have, over all queries."""
    both = approximate.select("query_id", "doc_id").join(exact.select("query_id", "doc_id").withColumn("__h", F.lit(1)), ["query_id", "doc_id"], "left")
    return both.agg(F.count("*").alias("n_hits"), F.sum(F.coalesce("__h", F.lit(0))).alias("n_both"), (F.sum(F.coalesce("__h", F.lit(0))) / F.count("*")).alias("recall"))


def refine_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean overlap and replacements of two lists of each query."""
    a = before.groupBy("query_id").agg(F.collect_set("doc_id").alias("a"))
    b = after.groupBy("query_id").agg(F.collect_set("doc_id").alias("b"))
    n = F.size(F.array_intersect("a", "b"))
    return a.join(b, "query_id").agg(F.avg(n).alias("avg_overlap"), F.avg(F.size("b") - n).alias("avg_replaced"))


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Exact percentiles by linear interpolation, extremes and mean."""
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def select_candidate(sweep: DataFrame, slack: float = 0.005) -> DataFrame:
    """Of sweep(name, recall, latency): the fastest with a recall within ``slack`` of the best."""
    best = sweep.withColumn("best", F.max("recall").over(Window.partitionBy())).where(F.col("recall") >= F.col("best") - slack)
    return best.agg(F.min_by("name", F.struct("latency", "name")).alias("name"), F.min("latency").alias("latency"))


def drift(old: DataFrame, new: DataFrame, cosine, *, eps: float, sample: int | None = None) -> DataFrame:
    """Largest and mean 1 - cosine of (doc_id, v) with itself, and how many exceed eps; optionally on a fixed sample."""
    both = old.select("doc_id", F.col("v").alias("a")).join(new.select("doc_id", F.col("v").alias("b")), "doc_id")
    if sample:
        both = both.orderBy(F.sha2(F.concat(F.lit("validate-"), F.col("doc_id").cast("string")), 256)).limit(sample)
    d = both.select((1 - cosine(F.col("a"), F.col("b"))).alias("d"))
    return d.agg(F.count("*").alias("n"), F.max("d").alias("max_drift"), F.avg("d").alias("mean_drift"), F.count_if(F.col("d") > eps).alias("n_failed"))
