"""Revisions of texts: which one last changed each line."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.sources.tables import checkpoint_root

#: Revisions whose lines are held at a time.
STEP = 100


def lines_of(text: str | None) -> list[str]:
    """Lines without their ends; the last end makes no empty line."""
    return text.removesuffix("\n").split("\n") if text else []


def carried(old: list[str], new: list[str]) -> list[int]:
    """For each new line the old one that it is carried from, or -1, by a longest common subsequence.

    Equal heads and tails go first. In between, each new line extends the shortest possible chains of old places that
    rise (Hunt and Szymanski): time follows the number of equal pairs, memory too.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    out = [*range(head), *[-1] * (len(new) - head - tail), *range(len(old) - tail, len(old))]
    places: dict[str, list[int]] = {}
    for i in range(len(old) - tail - 1, head - 1, -1):
        places.setdefault(old[i], []).append(i)
    ends: list[int] = []
    chains: list[tuple] = []
    for j in range(head, len(new) - tail):
        for i in places.get(new[j], ()):
            k = bisect.bisect_left(ends, i)
            link = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(i)
                chains.append(link)
            else:
                ends[k], chains[k] = i, link
    link = chains[-1] if chains else None
    while link:
        out[link[1]] = link[0]
        link = link[2]
    return out


def blame(revisions: DataFrame, *, path_col: str = "path", rev_col: str = "rev", text_col: str = "text", max_rounds: int = 64) -> DataFrame:
    """(path, line_no from 1, line, rev): the lines of each path's last revision, with the one that last changed them.

    Revisions follow one another by ``rev``. Each is compared with the one before it by itself, wherever it lies, so a
    path of very many revisions is no single task; that gives every line a pointer to the line it is carried from, and
    pointers are doubled until each leads to where its line came in, in a number of rounds that grows with the logarithm
    of the history. A null or empty text has no lines, and what comes after it is new. Of rows that repeat a revision the
    first text in order counts; a null path or rev takes no part.
    """
    checkpoint_root(revisions.sparkSession)
    rows = revisions.select(F.col(path_col).alias("path"), F.col(rev_col).alias("rev"), F.col(text_col).alias("text")).where("path is not null and rev is not null")
    rows = rows.groupBy("path", "rev").agg(F.min("text").alias("text"))
    order = rows.select("path", "rev").withColumn("no", F.row_number().over(Window.partitionBy("path").orderBy("rev")))
    rows = rows.join(order, ["path", "rev"]).checkpoint()
    before = rows.select("path", (F.col("no") + 1).alias("no"), F.col("text").alias("before"))

    def compared(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), STEP):
                out = []
                for path, no, text, old in pdf.iloc[lo : lo + STEP].itertuples(index=False, name=None):
                    new = lines_of(text)
                    out += [(path, no, i, *x) for i, x in enumerate(zip(new, carried(lines_of(old), new), strict=True))]
                yield pd.DataFrame(out, columns=["path", "no", "i", "line", "source"])

    kind = rows.schema["path"].dataType.simpleString()
    lines = rows.join(before, ["path", "no"], "left").select("path", "no", "text", "before").mapInPandas(compared, f"path {kind}, no int, i int, line string, source int")
    kept = F.col("source") >= 0
    lines = lines.select("path", "no", "i", "line", F.when(kept, F.col("no") - 1).otherwise(F.col("no")).alias("to_no"), F.when(kept, F.col("source")).otherwise(F.col("i")).alias("to_i")).checkpoint()
    at = lines.drop("line")
    for _ in range(max_rounds):
        step = at.select("path", F.col("no").alias("to_no"), F.col("i").alias("to_i"), F.col("to_no").alias("far_no"), F.col("to_i").alias("far_i"))
        far = at.join(step, ["path", "to_no", "to_i"]).select("path", "no", "i", F.col("far_no").alias("to_no"), F.col("far_i").alias("to_i"), (F.col("far_no") != F.col("to_no")).alias("moved")).checkpoint()
        at = far.drop("moved")
        if far.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"histories did not settle in {max_rounds} rounds")
    last = rows.groupBy("path").agg(F.max("no").alias("no"))
    names = rows.select("path", F.col("no").alias("to_no"), "rev")
    found = at.join(last, ["path", "no"]).join(names, ["path", "to_no"]).select("path", "no", "i", "rev")
    return found.join(lines.select("path", "no", "i", "line"), ["path", "no", "i"]).select("path", (F.col("i") + 1).cast("long").alias("line_no"), "line", "rev")
