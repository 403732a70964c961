"""Fill-in-the-middle: a text is cut at two ranks of its units by a matcher that never holds the units.

The first pass over the matches of the unit's pattern counts them. The second advances a lazy iterator of matches to the
lower and then to the higher rank and reads where those two matches end. Beside the text, one match is held.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of text. Any pattern may be given that never matches the empty string: words (r"\S+\s*"), lines (r"[^\n]*\n|[^\n]+").
CODE_POINT = r"(?s)."
#: What precedes prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, how many are transformed, and how many of these with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"
_CUT = "n long, prefix_chars long, middle_chars long, output string"


@functools.lru_cache
def _pattern(units: str) -> re.Pattern:
    out = re.compile(units)
    if out.match(""):
        raise ValueError("the pattern of a unit matches the empty string")
    return out


def count_units(pattern: re.Pattern, text: str) -> int:
    """First pass: how many matches there are; each is dropped as the next comes."""
    counter = itertools.count()
    deque(zip(pattern.finditer(text), counter), maxlen=0)
    return next(counter)


def ends_at(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the match of rank ``low`` and that of rank ``high`` end; rank 0 is the start of the text."""
    matches, at, end = pattern.finditer(text), 0, 0
    ends = []
    for rank in (low, high):
        if rank > at:
            end = next(itertools.islice(matches, rank - at - 1, None)).end()
            at = rank
        ends.append(end)
    return ends[0], ends[1]


def draws(id_: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits that depend on the id and the seed alone: the head of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", units: str = CODE_POINT, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per document row: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    The prefix ends with the unit of the lower of two drawn ranks of 0 to n, the middle with that of the higher; the
    rest, with what follows the last unit, is the suffix. A text is plain, thus its own output, if it is empty or null,
    holds a sentinel, or isn't drawn. Form and ranks depend on the id alone, so rows that repeat an id are drawn alike,
    each with its own text; a null id is drawn as an empty one. Other columns are ignored; an empty table gives none.
    There is no shuffle.
    """
    _pattern(units)
    first, last, middle = sentinels
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    plain = (text == "") | (h3 % 100 >= rate)
    for mark in sentinels:
        plain |= text.contains(mark)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")

    @F.pandas_udf(_CUT)
    def cut(text: pd.Series, form: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        pattern, rows = _pattern(units), []
        for t, f, a, b in zip(text, form, h1, h2, strict=True):
            n = count_units(pattern, t)
            if f == "plain":
                rows.append((n, None, None, t))
                continue
            a, b = a % (n + 1), b % (n + 1)
            i, j = ends_at(pattern, t, min(a, b), max(a, b))
            head = f"{last}{t[j:]}{first}{t[:i]}" if f == "spm" else f"{first}{t[:i]}{last}{t[j:]}"
            rows.append((n, i, j - i, f"{head}{middle}{t[i:j]}"))
        out = pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    drawn = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    return drawn.select("doc_id", "form", cut("text", "form", "h1", "h2").alias("cut")).select("doc_id", "cut.n", "form", "cut.prefix_chars", "cut.middle_chars", "cut.output")


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` of this form was made of; the sentinels are not in it, so they part it in one way."""
    first, last, middle = (re.escape(s) for s in sentinels)
    psm, spm = F.split(output, f"{first}|{last}|{middle}", -1), F.split(output, f"{last}|{first}|{middle}", -1)
    return F.when(form == "psm", F.concat(psm[1], psm[3], psm[2])).when(form == "spm", F.concat(spm[2], spm[3], spm[1])).otherwise(output)
