"""Scalar functions over texts, paths and symbols."""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "[A-Za-z0-9]+"
IDENTIFIER = "[A-Za-z0-9_]+"


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), F.lower)


def canonical(text: Column) -> Column:
    """Line ends, bullets, control characters and white space in one form, outside of Unicode composition."""
    s = F.regexp_replace(text, "\r\n?", "\n")
    s = F.regexp_replace(s, "[•◦–]", "-")
    s = F.regexp_replace(s, "[\\x00-\\x1F]", " ")
    return F.trim(F.regexp_replace(s, "\\s+", " "))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def doc_urn(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else "urn:doc:sha256:" + base64.b32encode(hashlib.sha256(s.encode()).digest()[:16]).decode().strip("=").lower())


def chunk_urn(doc: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("urn:chunk:"), F.element_at(F.split(doc, ":"), -1), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


@F.pandas_udf(T.LongType())
def chunk_id(uri: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """BLAKE2b-64 of ``uri|start|end``, little endian, as a signed number."""
    return pd.Series([int.from_bytes(hashlib.blake2b(f"{u}|{int(a)}|{int(b)}".encode(), digest_size=8).digest(), "little", signed=True) for u, a, b in zip(uri, start, end, strict=True)])


@F.pandas_udf(T.LongType())
def content_hash(text: pd.Series) -> pd.Series:
    """xxh64 with seed 0, in two's complement."""
    return text.map(lambda s: None if s is None else int.from_bytes(xxhash.xxh64_digest(s.encode()), "big", signed=True)).astype("Int64")


@F.pandas_udf(T.StringType())
def node_id(path: pd.Series, line: pd.Series, col: pd.Series, kind: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([hashlib.blake2s(f"{p}:{a}:{b}:{k}:{n or ''}".encode(), digest_size=16).hexdigest() for p, a, b, k, n in zip(path, line, col, kind, name, strict=True)])


@F.pandas_udf(T.StringType())
def path_id(path: pd.Series) -> pd.Series:
    return path.map(lambda s: None if s is None else hashlib.blake2s(s.encode()).hexdigest()[:12])


def module_name(path: Column) -> Column:
    """src/pkg/mod.py and src/pkg/mod/__init__.py are pkg.mod."""
    p = F.regexp_replace(F.regexp_replace(path, r"^(?:\./)?(?:src/)?", ""), r"\.pyi?$", "")
    return F.regexp_replace(F.regexp_replace(p, r"/__init__$", ""), "/", ".")


def relative_module(module: Column, level: Column, target: Column) -> Column:
    """A relative import drops as many trailing parts as it has dots, packages included."""
    parts = F.split(module, r"\.")
    base = F.concat_ws(".", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0))))
    return F.when(level <= 0, target).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(target, F.lit(""))))


def symbol_name(symbol: Column) -> Column:
    """The last descriptor of a SCIP symbol."""
    return F.regexp_extract(F.regexp_replace(symbol, r"[.#()/:]+$", ""), r"([A-Za-z0-9_]+)$", 1)


def snippet(text: Column, length: int = 400) -> Column:
    return F.substring(F.trim(text), 1, length)


def truncated(text: Column, tokens_: Column, per_token: int = 4) -> Column:
    """At most so many characters, cut at the last newline of those and marked."""
    most = tokens_ * per_token
    head = F.substring(text, F.lit(1), most)
    at = F.length(head) - F.instr(F.reverse(head), "\n")
    cut = F.when(F.instr(head, "\n") > 1, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("\n…")))


def preview(text: Column, length: int = 200) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def doc_summary(doc: Column, length: int = 200) -> Column:
    """The first non-blank line of a docstring."""
    line = F.trim(F.regexp_extract(F.coalesce(doc, F.lit("")), r"^\s*([^\n]*)", 1))
    return F.when(F.length(line) > length, F.concat(F.substring(line, 1, length - 3), F.lit("..."))).otherwise(line)


def as_int(value: Column) -> Column:
    return F.coalesce(value.try_cast("long"), F.lit(0))


def quantised_document(weight: Column, scale: int = 100) -> Column:
    return F.floor(weight * scale + 0.5).cast("long")


def quantised_query(weight: Column, scale: int = 100, most: int = 256) -> Column:
    """Half to even, with a cap on repetitions."""
    return F.least(F.bround(weight * scale, 0), F.lit(most)).cast("long")


def decayed(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def ranking_ids(answer: Column) -> Column:
    """The ids of a model's answer: the JSON list between the first [ and the last ]."""
    return F.array_distinct(F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<bigint>"), F.array().cast("array<bigint>")))
