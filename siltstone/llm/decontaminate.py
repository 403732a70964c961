"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written

#: A-Z become a-z; ASCII outside 0-9 and a-z separates words; every other byte belongs to a word.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WINDOW = 10
#: Bytes of normalised windows in one automaton, which takes about twelve times as much; a larger benchmark is scanned for
#: in several blocks, one after the other, with the same results.
BLOCK_BYTES = 16 << 20


def windows_of(text: str | None, width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The distinct windows of an item, as words."""
    words = (text or "").encode().translate(_NORMAL).split()
    if not words:
        return []
    return list({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})


class Automaton:
    """Aho-Corasick over words: a word of the block is a number, any other one is 0. A window takes as many nodes as it
    has words, not bytes."""

    def __init__(self, block: list[tuple[str, list[tuple[bytes, ...]]]]):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        for k, (_, windows) in enumerate(block):
            for w in windows:
                owners.setdefault(tuple(self.number.setdefault(x, len(self.number) + 1) for x in w), []).append(k)
        self.names = [i for i, _ in block]
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if owners else None
        for w, items in owners.items():
            self.found.add_word(w, (len(w), items))
        if self.found is not None:
            self.found.make_automaton()

    def hits(self, words: list[bytes]):
        """(last word, number of words, items) of each occurrence."""
        get = self.number.get
        return self.found.iter(tuple([get(w, 0) for w in words])) if words and self.found is not None else ()


def _scan(text: str, automaton: Automaton) -> tuple[int, set[int], np.ndarray | None, bytes]:
    """Number of words, items found, mask of hit words (None without a hit), normalised bytes."""
    flat = text.encode().translate(_NORMAL)
    words = flat.split()
    items: set[int] = set()
    edge = None
    for last, (n, owners) in automaton.hits(words):
        if edge is None:
            edge = np.zeros(len(words) + 1, np.int32)
        edge[last + 1 - n] += 1
        edge[last + 1] -= 1
        items.update(owners)
    return len(words), items, None if edge is None else np.cumsum(edge[:-1]) > 0, flat


def _spans(text: str, flat: bytes, mask: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as character offsets [start, end) of the original text."""
    bounds = np.array([m.span() for m in re.finditer(rb"[^ ]+", flat)])
    turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    raw = text.encode()
    out, at, chars = [], 0, 0
    for first, last in zip(turn[::2], turn[1::2] - 1, strict=True):
        pair = []
        for byte in (bounds[first][0], bounds[last][1]):
            chars += len(raw[at:byte].decode())
            at = byte
            pair.append(chars)
        out.append({"start": pair[0], "end": pair[1]})
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_bytes: int):
    """The benchmark's patterns, streamed to the driver in blocks of a bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null")
    for r in rows.toLocalIterator():
        if found := windows_of(r.t, width):
            block.append((r.i, found))
            size += sum(len(w) + 1 for window in found for w in window)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (array of item ids as strings), spans (character offsets of hits).

    No shuffle: documents are scanned where they are read. Null and empty texts have no words, hits or items; items
    that are null, empty or of null id have no windows; repeated document rows each give a row; repeated items count
    by their id once; an empty benchmark hits nothing. Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("array()").cast("array<string>").alias("items"), F.expr("array()").cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("mask"))
    schema = out.schema
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    while True:
        out = out.mapInPandas(_scanner(_shared(spark, block), following is None, schema.names), schema)
        if following is None:
            return out.select("doc_id", "n_words", "n_hit", "items", "spans")
        # each block's scan is a job of its own: a worker holds one automaton
        out, block, following = written(out, "scanned"), following, next(blocks, None)


def _scanner(shared, last: bool, names: list[str]):
    def scan(batches):
        automaton = Automaton(shared.value)
        for pdf in batches:
            cols = {c: [] for c in ("n_words", "items", "spans", "n_hit", "mask")}
            for text, items, mask in zip(pdf["text"], pdf["items"], pdf["mask"], strict=True):
                text = text or ""
                n, found, hit, flat = _scan(text, automaton)
                if mask is not None:
                    old = np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)
                    hit = old if hit is None else hit | old
                cols["n_words"].append(n)
                cols["items"].append(sorted({*items, *(automaton.names[i] for i in found)}))
                cols["n_hit"].append(0 if hit is None else int(hit.sum()))
                cols["spans"].append(_spans(text, flat, hit) if last and hit is not None else [])
                cols["mask"].append(None if last or hit is None else np.packbits(hit).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": None if last else pdf["text"], **cols})[names]

    return scan


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, as they are. Null and empty texts have none; repeated rows are judged alike; with an
    empty table there are none, with an empty benchmark all stay."""
    out = docs
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_bytes)):
        out = written(out, "clean") if k else out
        out = out.where(F.pandas_udf(_cleaner(_shared(docs.sparkSession, block)), "boolean")(F.col(text_col)))
    return out


def _cleaner(shared):
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(shared.value)
        for texts in batches:
            yield pd.Series([next(iter(automaton.hits((t or "").encode().translate(_NORMAL).split())), None) is None for t in texts], dtype=bool)

    return clean


def _shared(spark, block):
    return spark.sparkContext.broadcast(block)
