"""Values of JSON files that span lines, read in splits: brackets are counted by line and summed over blocks.

A line break can't stand inside a JSON string, so each line's brackets can be counted by themselves. Sums over the blocks
that Spark's text reader cuts a file into give the depth at which each block begins, running sums in a block that of each
line; only then is a line cut where values begin and end. No file is read by one task.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[{]|[\]}]')
_PIECES = "array<struct<text:string,first:boolean,last:boolean>>"


def pieces(line: str, at: int, depth: int) -> list[tuple[str, bool, bool]]:
    """The parts of a line that belong to values which begin at ``depth``: (text, begins here, ends here).

    ``at`` is the depth where the line begins.
    """
    out, start, begun = [], 0 if at > depth else None, False
    for m in _TOKEN.finditer(line):
        c = m[0]
        if c in "[{":
            if at == depth:
                start, begun = m.start(), True
            at += 1
        elif c in "]}":
            at -= 1
            if at == depth and start is not None:
                out.append((line[start : m.end()], begun, True))
                start, begun = None, False
    if start is not None:
        out.append((line[start:], begun, False))
    return out


def _cut(line: pd.Series, at: pd.Series, depth: pd.Series) -> pd.Series:
    return pd.Series([[{"text": t, "first": f, "last": e} for t, f, e in pieces(*x)] for x in zip(line, at, depth, strict=True)], dtype=object)


def json_frames(spark: SparkSession, path: str, depth: int = 0) -> DataFrame:
    """(file, at, text): the objects and arrays that begin at a depth of nesting, in files of any number of them.

    ``at`` rises in the order of the file; it isn't consecutive. Depth 0 gives the outermost values, depth 2 the elements
    of the arrays in an outermost object. A value over many lines, or over many blocks, is whole; one that a file breaks
    off in is left out, and so is what stands between values. Brackets that don't match spoil what follows them in the
    file. Compressed files are one block each.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    bare = F.regexp_replace("value", _STRING, "")
    lines = lines.withColumn("delta", F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]")))
    sums = lines.groupBy("file", "block").agg(F.sum("delta").alias("d"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = sums.select("file", "block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("begin"))
    above = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("above", F.coalesce(F.sum("delta").over(above), F.lit(0))).join(begin, ["file", "block"])
    cut = placed.select("file", "block", "n", F.posexplode(F.pandas_udf(_cut, _PIECES)("value", F.col("begin") + F.col("above"), F.lit(depth))).alias("i", "p"))
    so_far = Window.partitionBy("file", "block").orderBy("n", "i").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.select("file", "block", "n", "i", "p.*").withColumn("c", F.sum(F.col("first").cast("long")).over(so_far))
    text = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "\n").alias("text")
    parts = cut.groupBy("file", "block", "c").agg(text("n", "i"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))
    whole = parts.where("first and last").select("file", (F.col("block") + F.col("c")).alias("at"), "text")
    # At most two parts of a block belong to values that reach over its ends; they meet by the block in which the value begins.
    torn = parts.where("not (first and last)")
    runs = Window.partitionBy("file").orderBy("block", "c").rowsBetween(Window.unboundedPreceding, 0)
    torn = torn.withColumn("at", F.max(F.when(F.col("first"), F.col("block") + F.col("c"))).over(runs))
    joined = torn.groupBy("file", "at").agg(text("block", "c"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))
    return whole.unionByName(joined.where("first and last").select("file", "at", "text"))
