"""Mixing sources: token weights raked to source, language and topic marginals, then calibrated sampling."""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm.common import checkpoint_root, together, written

_log = logging.getLogger(__name__)
DIMENSIONS = ("source", "lang", "topic")
#: A marginal's target share of tokens is its own share to this power, normalised, where no target is given.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: How far off its target a sum may be at the end of a round; rounds after which raking that still comes closer is an
#: error. Marginals that no weights can meet together, or only weights of 0 where there are none, come closer ever more
#: slowly: three rounds that each bring less than STALL of the distance end the raking, and that is logged.
TOLERANCE = 1e-12
ROUNDS = 500
STALL = 0.05
#: Share of all tokens that the sample has in expectation.
BUDGET = 0.8
#: Up to this many cells the weights are broadcast; beyond it they are joined by shuffle.
BROADCAST_CELLS = 100_000
#: Cells of a partition of raked cells.
CELLS_A_TASK = 200_000
_SPACE = 1 << 32


def topic_of(text: Column) -> Column:
    """The default topic: what kind of text it is."""
    return F.when(text.contains("icensed under") | text.contains("Released under"), "legal").when(text.contains("@"), "contact").when(F.length(text) >= 6000, "long").otherwise("general")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("double")


def draw(id_: Column) -> Column:
    """A number in [0, 1) that depends on the id alone, so a document is drawn alike on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / _SPACE


def _targets(cells: DataFrame, d: str, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """(d, t): the target share of each of the dimension's values that occur."""
    sums = cells.groupBy(d).agg(F.sum("c").alias("m"))
    if targets and d in targets:
        given = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv])
        return sums.select(d, F.coalesce(F.element_at(given, F.col(d)), F.lit(0.0)).alias("t"))
    sums = sums.where("m > 0").withColumn("t", F.pow("m", F.lit(TEMPER[d])))
    whole = sums.agg(F.sum("t")).first()[0]
    return sums.select(d, (F.col("t") / F.lit(whole)).alias("t"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Iterative proportional fitting of ``cells(source, lang, topic, c)``: adds w, of the same total as c.

    Each dimension's sums are aggregated and joined back, so no task holds more than CELLS_A_TASK cells; a round's result is written, which
    cuts lineage and keeps the planner's size estimates true. It ends when no sum is off its target by more than
    ``tolerance`` of it. Where marginals contradict one another it ends when they hardly come closer, with a warning; the
    last dimension's are met then. If they still come closer after ROUNDS, it raises an error; a caller who gives
    ``rounds`` gets what these reach. Null keys are cells of 'unknown'; repeated cells keep a row each, scaled alike; null and negative c
    count as 0. A cell whose target is 0, or not given where the dimension's are, gets 0; a target that no cell meets
    is left out. An empty table, or one without mass, keeps its rows with w 0.
    """
    out = cells.select(*[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in DIMENSIONS], F.greatest(F.coalesce(F.col("c").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("c"))
    out = written(out.withColumn("w", F.col("c")), "cells")
    size = out.agg(F.count("*").alias("n"), F.sum("c").alias("c")).first()
    total = size.c or 0.0
    if total <= 0:
        return out
    goals = out
    for d in DIMENSIONS:
        goals = goals.join(_targets(out, d, targets).withColumnRenamed("t", f"t_{d}"), d, "left")
    kept = [*DIMENSIONS, "c", *[f"t_{d}" for d in DIMENSIONS]]
    out = written(goals.select(*kept, "w").repartition(-(-size.n // CELLS_A_TASK)), "goals")
    # Cells of one task at most are one partition, where sums over a dimension need no shuffle; more are joined with them.
    small = size.n <= CELLS_A_TASK
    last, still = math.inf, 0
    for k in range(rounds or ROUNDS):
        out = (out.coalesce(1) if small else out).withColumn("off", F.lit(0.0))
        for d in DIMENSIONS:
            if small:
                goal, total_of = F.col(f"t_{d}"), F.sum("w").over(Window.partitionBy(d))
            else:
                goal, total_of = F.first(f"t_{d}"), F.sum("w")
            factor = F.coalesce(goal * total / F.nullif(total_of, F.lit(0.0)), F.lit(0.0)).alias("f")
            out = out.select("*", factor) if small else out.join(out.groupBy(d).agg(factor), d)
            off = F.greatest("off", F.when(F.col("w") > 0, F.abs(F.col("f") - 1)).otherwise(0.0))
            out = out.select(*kept, (F.col("w") * F.col("f")).alias("w"), off.alias("off"))
        seen = Observation(f"raked {k}")
        out = written(out.observe(seen, F.max("off").alias("off")), "raked").drop("off")
        off = seen.get["off"]
        still = still + 1 if off >= last * (1 - STALL) else 0
        if off <= tolerance or (still == 3 and rounds is None):
            _log.info("raked in %s rounds", k + 1)
            break
        last = off
    else:
        if rounds is None:
            raise RuntimeError(f"marginals are still {off} off their targets after {ROUNDS} rounds")
    if off > tolerance and rounds is None:
        _log.warning("the marginals can hardly be met together: sums stay up to %s of their targets off", off)
    return out.select(*DIMENSIONS, "c", "w")


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds p = min(1, s w/c), with s such that the expected tokens are the budget's share of all, if that can be.

    Cells that s carries to 1 are full; s grows by what they can't take until no more cells fill up, a sum over the
    cells each time. Cells without tokens are left out; one without weight has p 0; where all that have weight are
    full, p is 1. Ties fill up together. An empty table gives none.
    """
    out = cells.where("c > 0").withColumn("r", F.col("w") / F.col("c"))
    every = out.agg(F.sum("c").alias("c"), F.sum("w").alias("w")).first()
    scale, full = None, -1
    if every.w:
        scale = budget * every.c / every.w
        while True:
            top = out.where(F.col("r") * F.lit(scale) > 1).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("w").alias("w")).first()
            if top.n == full:
                break
            full, left = top.n, every.w - (top.w or 0.0)
            if left <= 1e-12 * every.w:
                scale = None
                break
            scale = (budget * every.c - (top.c or 0.0)) / left
    p = F.lit(1.0) if scale is None else F.least(F.lit(1.0), F.lit(scale) * F.col("r"))
    return out.select(*DIMENSIONS, "c", "w", F.when(F.col("w") <= 0, 0.0).otherwise(p).alias("p"))


def _weighed(docs: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float, topic: Column | None, id_col: str, text_col: str, source_col: str, lang_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names of ``apart``, with the struct mix(source, lang, topic, tokens, weight, p, kept)."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    text = F.col(text_col)
    keys = F.struct(unknown(source_col).alias("source"), unknown(lang_col).alias("lang"), F.coalesce(topic if topic is not None else topic_of(text), F.lit("unknown")).alias("topic"), tokens_of(text).alias("tokens"))
    keyed = docs.select(*docs.columns, keys).toDF(*(names := {c: f"d{i}" for i, c in enumerate(docs.columns)}).values(), "cell")
    cells = keyed.groupBy(*[F.col(f"cell.{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("cell.tokens").alias("c"))
    cells = calibrate(rake(cells.where("c > 0"), targets), budget)
    checkpoint_root(docs.sparkSession)
    cells = cells.select(F.struct(*DIMENSIONS).alias("key"), F.struct((F.col("w") / F.col("c")).alias("weight"), "p").alias("found")).checkpoint()
    side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    joined = keyed.withColumn("key", F.struct(*[F.col(f"cell.{d}") for d in DIMENSIONS])).join(side, "key", "left")
    p = F.coalesce("found.p", F.lit(1.0))
    mix = F.struct(*[F.col(f"cell.{d}").alias(d) for d in DIMENSIONS], F.col("cell.tokens").cast("long").alias("tokens"), F.coalesce("found.weight", F.lit(0.0)).alias("weight"), p.alias("p"), (draw(F.col(names[id_col])) < p).alias("kept"))
    return joined.select(*names.values(), mix.alias("mix")), names


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, budget: float = BUDGET, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Per document row: doc_id, source, lang, topic, tokens, weight, p, kept.

    Token counts are summed by cell (source, language, topic) before anything is shuffled, so that a hot source is
    one row a task; raking and calibration touch cells only. Null sources, languages and topics are cells of their
    own ('unknown'). A document without tokens has weight 0 and p 1; one in a cell without weight has 0 and 0. Repeated
    ids are drawn alike, each row by itself. Other columns are ignored; an empty table gives none. No Python runs on
    the executors, and nothing is collected.
    """
    out, names = _weighed(docs, targets, budget, topic, id_col, text_col, source_col, lang_col)
    return out.select(F.col(names[id_col]).alias("doc_id"), "mix.*")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, budget: float = BUDGET, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The documents that are drawn, with their own columns."""
    out, names = _weighed(docs, targets, budget, topic, id_col, text_col, source_col, lang_col)
    return together(out.where("mix.kept"), names)
