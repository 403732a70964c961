"""Chunks of sources and texts: packing of ordered symbols under a budget, offsets, related definitions."""

from __future__ import annotations

import bisect
import itertools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BUDGET = 2200


def split_large(text: str, start: int, end: int, budget: int) -> list[tuple[int, int]]:
    """Pieces of at most the budget, cut after a blank line in the second half of a piece where there is one."""
    out, at = [], start
    while at < end:
        stop = min(at + budget, end)
        blank = text.rfind("\n\n", at + budget // 2, stop)
        if blank > at:
            stop = blank + 1
        out.append((at, stop))
        at = stop
    return out


def pack_text(text: str, spans: list[tuple[int, int, str]], budget: int) -> list[tuple[int, int, list[str]]]:
    """Ordered symbol spans as chunks: neighbours share one while it fits, a span over the budget is split."""
    out: list[tuple[int, int, list[str]]] = []
    open_: tuple[int, int, list[str]] | None = None
    for start, end, name in spans:
        if open_ and max(open_[1], end) - open_[0] <= budget:
            open_ = (open_[0], max(open_[1], end), [*open_[2], name])
            continue
        first = open_ is None
        if open_:
            out.append(open_)
        if not first and end - start > budget:
            out += [(a, b, [name]) for a, b in split_large(text, start, end, budget)]
            open_ = None
        else:
            open_ = (start, end, [name])
    return out + [open_] if open_ else out


def line_spans(text: str) -> list[dict]:
    """Each line without its end as a span, by one running sum over their lengths."""
    lines = text.split("\n")
    ends = itertools.accumulate(len(x) + 1 for x in lines)
    return [{"start": e - 1 - len(x), "end": e - 1, "symbol": f"line{i}"} for i, (x, e) in enumerate(zip(lines, ends, strict=True))]


def pack(files: DataFrame, budget: int = BUDGET, *, by_line: bool = False) -> DataFrame:
    """Chunks of files(uri, text, spans array<struct<start, end, symbol>>): character, byte and line offsets and text.

    ``by_line`` takes the lines of a text as its spans; ``files`` needs no spans then. Bytes are counted from chunk to
    chunk, so a text is encoded once.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for uri, text, spans in zip(pdf["uri"], pdf["text"], pdf["text"] if by_line else pdf["spans"], strict=True):
                text = text or ""
                spans = line_spans(text) if by_line else spans
                order = sorted((s["start"], s["end"], s["symbol"]) for s in (spans if spans is not None else ()))
                lines = [m.start() for m in re.finditer("\n", text)]
                at = before = 0
                for n, (a, b, names) in enumerate(pack_text(text, order, budget)):
                    if b > a:
                        if a >= at:
                            before += len(text[at:a].encode())
                        else:
                            before -= len(text[a:at].encode())
                        at = a
                        rows.append((uri, n, a, b, before, before + len(text[a:b].encode()), bisect.bisect_left(lines, a), bisect.bisect_left(lines, b - 1), names, text[a:b]))
            yield pd.DataFrame(rows, columns=["uri", "n", "start_char", "end_char", "start_byte", "end_byte", "start_line", "end_line", "symbols", "text"])

    return files.select("uri", "text", *([] if by_line else ["spans"])).mapInPandas(run, "uri string, n int, start_char long, end_char long, start_byte long, end_byte long, start_line int, end_line int, symbols array<string>, text string")


def greedy_groups(rows: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """(keys, order, chunk): the number of each row's group; a group closes when the next row exceeds the budget.

    Rows of a key are together and in order, equal ones by size, and are walked with one number held, so a key of very
    many rows is never one array. A null size counts as 0.
    """
    columns = [*keys, order]
    ranged = rows.select(*columns, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size")).repartition(*keys).sortWithinPartitions(*columns, "__size")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        key, used, group = object(), 0, 0
        for batch in batches:
            groups = []
            for *now, n in zip(*(batch.column(c).to_pylist() for c in [*keys, "__size"]), strict=True):
                if now != key:
                    key, used, group = now, n, 0
                elif used == 0 or used + n <= budget:
                    used += n
                else:
                    used, group = n, group + 1
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(groups, pa.int64())], [*columns, "chunk"])

    return ranged.mapInArrow(run, f"{kinds}, chunk long")


def related(calls: DataFrame, defs: DataFrame, most: int = 8) -> DataFrame:
    """Per chunk of calls(chunk_id, name, pos): the first definitions that it calls, joined as text."""
    found = calls.join(defs.select("name", "signature"), "name").groupBy("chunk_id", "name").agg(F.min("pos").alias("pos"), F.min("signature").alias("signature"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos", "name"))).where(F.col("r") <= most)
    return found.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", "signature"))).getField("signature"), "\n").alias("context"))


def turns_text(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The rows of each key in order, as one text."""
    return turns.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct(order, text))).getField(text), "\n").alias("text"))
