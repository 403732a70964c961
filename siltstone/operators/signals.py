"""Small row operators: concepts, slices, scope defaults, ratios, explanations, overlay candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concepts_of(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The concepts of which a keyword is in the text, in any case; sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for concept, words in sorted(keywords.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        found.append(F.when(hit, concept))
    return F.array_compact(F.array(*found))


def find_concepts(concepts: DataFrame, part: str, limit: int, name: str = "name") -> DataFrame:
    """Concepts whose name holds a part, in any case: the first by name."""
    return concepts.where(F.lower(name).contains(part.lower())).orderBy(name).limit(limit)


def slices(modules: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    """Modules with any of the tags; all where none are asked for."""
    return modules if not wanted else modules.where(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])))


def scoped(row: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Explicit values, or else the session's defaults."""
    return row.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def needs_overlay(modules: DataFrame) -> Column:
    """Untyped hubs and modules with type errors want a stub overlay."""
    return F.col("is_hub") | (F.col("type_errors") > 0) | ((F.col("param_ratio") < 0.5) & (F.col("fan_in") >= 2))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def coverage_trio(rows: DataFrame) -> DataFrame:
    """Shares of functions that are chunked, indexed and retrieved."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_ratio")
    return rows.agg(F.count("*").alias("n"), share("chunked"), share("indexed"), share("retrieved"))


def explained(alignments: Column) -> Column:
    """``q0→d3=0.91`` and so on, of array<struct<q, d, s>>."""
    return F.array_join(F.transform(alignments, lambda a: F.format_string("q%d→d%d=%.2f", a["q"], a["d"], a["s"])), ", ")


def reasons(channels: Column, symbols: Column, kind: Column) -> Column:
    """Why a hit is there: its channels, matched symbols and syntax kind."""
    return F.concat(F.transform(channels, lambda c: F.concat(F.lit("channel:"), c)), F.transform(F.coalesce(symbols, F.array().cast("array<string>")), lambda s: F.concat(F.lit("symbol:"), s)), F.array_compact(F.array(F.concat(F.lit("ast:"), kind))))


def merged_weights(defaults: Column, override: Column) -> Column:
    """Channel weights with a caller's taking precedence."""
    return F.map_zip_with(defaults, override, lambda k, a, b: F.coalesce(b, a))
