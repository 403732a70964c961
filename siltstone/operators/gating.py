"""Query profiles, budgets, stage gates and limits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that start a search for code; patterns of code-like words; thresholds.
HEAD_TERMS = (
    "how", "find", "where", "get", "set", "create", "update", "delete", "auth", "login", "error", "bug",
    "serialize", "deserialize", "connect", "database", "config", "configuration", "path", "file", "read", "write", "parse", "build",
    "test", "mock", "client", "server", "handle", "exception", "timeout",
)
CODE_WORDS = (
    r"^[A-Za-z_][A-Za-z0-9_]*$",
    r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+$",
    r"^[a-z0-9_]+(?:\.[a-z0-9_]+)+$",
    r"^[A-Za-z0-9_\-/\.]+$",
)
SYMBOLIC = r"(?:\w+::\w+)|(?:\w+\.\w+)|(?:[/\\])|(?:[A-Za-z]+[A-Z][a-z]+)|(?:[A-Za-z_]+\d+)"
DEPTHS = {"default": {"semantic": 100, "bm25": 50, "splade": 50}, "literal": {"semantic": 80, "bm25": 80, "splade": 30}, "vague": {"semantic": 150, "bm25": 60, "splade": 80}}
RRF_K = {"default": 60, "literal": 40, "vague": 90}


def _is_code(word: Column) -> Column:
    return functools.reduce(Column.__or__, [word.rlike(p) for p in CODE_WORDS])


def profile(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Length, shares of unique, code-like, numeric and unknown words, share of symbols, two flags and an ambiguity."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    q = queries.select(F.col(id_col).alias("query_id"), text.alias("t"), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("w"))
    n = F.size("w")
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    q = q.select("query_id", n.cast("long").alias("length"), share(F.size(F.array_distinct("w"))).alias("unique_ratio"), share(F.size(F.filter("w", _is_code))).alias("code_token_ratio"), share(F.size(F.filter("w", lambda w: w.rlike("[0-9]")))).alias("digit_ratio"), (F.length(F.regexp_replace("t", r"[A-Za-z0-9_\s]", "")) / F.greatest(F.length("t"), F.lit(1))).alias("symbol_ratio"))
    q = q.withColumn("oov_ratio", 1.0 - F.col("code_token_ratio"))
    q = q.withColumn("looks_literal", F.expr("code_token_ratio > 0.5 or digit_ratio > 0.2 or symbol_ratio > 0.03"))
    q = q.withColumn("looks_vague", F.expr("not looks_literal and length <= 5 and code_token_ratio < 0.3"))
    return q.withColumn("ambiguity", F.expr("greatest(0.0D, least(1.0D, if(length <= 3 and code_token_ratio < 0.3, 0.6D, 0.0D) + if(oov_ratio > 0.6, 0.3D, 0.0D) - if(looks_literal, 0.4D, 0.0D)))"))


def budgets(profiles: DataFrame) -> DataFrame:
    """Depth of each channel, the constant of rank fusion and whether feedback runs."""
    kind = F.when(F.col("looks_literal"), "literal").when(F.expr("looks_vague or ambiguity >= 0.5"), "vague").otherwise("default")
    pick = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("kind")).cast("long")
    out = profiles.withColumn("kind", kind)
    depths = [pick({k: d[c] for k, d in DEPTHS.items()}).alias(f"{c}_depth") for c in ("semantic", "bm25", "splade")]
    return out.select("query_id", "kind", *depths, pick(RRF_K).alias("rrf_k"), F.col("length").between(2, 12).alias("rm3"))


def stage_gate(signals: DataFrame, *, min_candidates: int = 40, budget_ms: float = 150, margin: float = 0.1) -> DataFrame:
    """Adds should_run and reason to (candidate_count, elapsed_ms, best, second)."""
    apart = F.col("best") - F.col("second")
    reason = F.when(F.col("candidate_count") <= 0, "no_candidates").when(F.col("candidate_count") < min_candidates, "insufficient_candidates").when(F.col("elapsed_ms") > budget_ms, "upstream_budget_exceeded").when((apart >= margin) & (F.lit(margin) > 0), "high_margin").otherwise("within_budget")
    return signals.withColumn("reason", reason).withColumn("should_run", F.col("reason") == "within_budget")


def wants_feedback(text: Column, short: int = 3) -> Column:
    """Short queries do, those with symbols don't, others if they have a head term."""
    words = F.filter(F.split(F.lower(text), "[^A-Za-z0-9_]+"), lambda w: w != "")
    heads = F.array(*[F.lit(w) for w in HEAD_TERMS])
    return F.when(F.coalesce(text, F.lit("")) == "", False).when(F.size(words) <= short, True).when(text.rlike(SYMBOLIC), False).otherwise(F.arrays_overlap(words, heads))


def fan_out(limit: Column, filtered: Column, *, most: int = 200, factor: float = 2.0, bonus: int = 0) -> Column:
    """How many candidates a limited, perhaps filtered, search asks for."""
    bounded = F.greatest(F.lit(1), F.least(limit, F.lit(most)))
    return (F.ceil(bounded * F.when(filtered, factor).otherwise(1.0)) + bonus).cast("long")
