"""SQL scripts, statement by statement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PIECE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|.", re.S)


def statements(script: str) -> list[str]:
    """The statements of a script; semicolons inside quotes and comments don't end one."""
    out, now = [], []
    for piece in _PIECE.findall(script):
        if piece == ";":
            out.append("".join(now).strip())
            now = []
        elif not piece.startswith(("--", "/*")):
            now.append(piece)
    out.append("".join(now).strip())
    return [s for s in out if s]


def run_script(spark: SparkSession, script: str, **args) -> list[DataFrame]:
    """A frame for each statement; values go in as parameters, never as text."""
    return [spark.sql(s, args=args) if args else spark.sql(s) for s in statements(script)]
