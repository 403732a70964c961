"""Suffix-array deduplication: bytes covered by a long string that also starts in an earlier document are removed.

Every 50-byte window owns one anchor: the 20-byte string in it of least hash. Consecutive windows of one anchor make
a segment of 50 to 80 bytes. Equal windows have equal anchors, so comparing the segments of each anchor compares all
windows. Documents are dealt in the order of doc_id into packs; a pack asks once for each distinct segment it holds,
so a passage in a third of all rows is a row a pack. In the first exchange only hashes travel: they tell which
segments occur whole in an earlier pack, and which meet other segments of their anchor. Only the latter (each distinct
one once) travel as bytes, to be compared window by window by longest previous factors in suffix order.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from siltstone.llm.common import apart, integral, numbered, together, written
from siltstone.llm.shingles import mix

LENGTH, ANCHOR = 50, 20
_PER = LENGTH - ANCHOR + 1
PACK_BYTES = 1 << 20
#: Windows that are hashed at a time; strings of frequent anchors that a task remembers to have asked for.
SLICE, HELD_KEYS = 2 << 20, 1 << 19
#: Bytes of text behind one bucket of the exchange, which bounds what a task holds.
BUCKET_BYTES = 16 << 20
#: Packs whose anchors are counted to find frequent ones, the documents of these that one must occur in, how many are
#: marked at most, and the bits of a string's hash that are its mark. This sample steers which anchors are chosen, so
#: that none gathers a large group; results don't depend on it.
SAMPLE_PACKS, FREQUENT_DOCS, MOST_FREQUENT, MARK_BITS = 48, 8, 1 << 14, 20
#: Windows take more room than hashes: they are compared in so many times the buckets.
FINER = 16
_TABLE = np.random.default_rng(31337).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_ODD, n, 1 << 64))


def segments(flat: np.ndarray, lens: np.ndarray, frequent: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The segments of a pack: first window, number of windows, document, anchor hash, hash of the whole segment.

    A string that ``frequent`` marks is an anchor only of windows that hold no other: the mark depends on the string
    alone, so equal windows still have equal anchors. A long pack is worked off in slices of SLICE windows, which cut
    no window.
    """
    ends = np.cumsum(lens)
    found = [_segments(flat[lo : lo + SLICE + LENGTH - 1], lo, ends, frequent) for lo in range(0, max(1, len(flat) - LENGTH + 1), SLICE)]
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]} if len(found) > 1 else found[0]


def _segments(flat: np.ndarray, lo: int, ends: np.ndarray, frequent: np.ndarray | None) -> dict[str, np.ndarray]:
    none = {k: np.zeros(0, t) for k, t in (("start", np.int64), ("n", np.int64), ("doc", np.int64), ("anchor", np.uint64), ("whole", np.uint64), ("mark", np.int64))}
    if len(flat) < LENGTH:
        return none
    h1 = _TABLE[flat]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    anchor = h16[:-4] * _power(4) + h4[16:]
    rank = mix(anchor)
    rank >>= np.uint64(1)
    if frequent is not None:
        high = anchor.view(np.uint32)[1::2] >> np.uint32(32 - MARK_BITS)
        rank[np.flatnonzero(frequent[high])] |= np.uint64(1 << 63)
    rank &= np.uint64(0xFFFFFFFF00000000)
    rank |= np.arange(len(rank), dtype=np.uint64)
    least, width = rank, 1
    while width * 2 <= _PER:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (_PER - width)], least[_PER - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low, high = np.searchsorted(ends, (lo, lo + len(at) - 1), "right")
    doc = np.repeat(np.arange(low, high + 1), np.diff(np.minimum(ends[low : high + 1], lo + len(at)), prepend=lo))
    ok = np.arange(lo + LENGTH, lo + LENGTH + len(at)) <= np.repeat(ends[low : high + 1], np.bincount(doc - low, minlength=high + 1 - low))
    turn = np.ones(len(at), bool)
    turn[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    turn |= ~ok
    first = np.flatnonzero(turn)
    n = np.diff(np.append(first, len(at)))
    use = ok[first]
    first, n = first[use], n[use]
    if not len(first):
        return none

    def window(i):
        x = (h16[i] * _power(16) + h16[i + 16]) * _power(16) + h16[i + 32]
        return x * _power(2) + h2[i + 48]

    whole = mix(mix(window(first)) * np.uint64(_ODD) + window(first + n - 1) + n.astype(np.uint64))
    return {"start": first + lo, "n": n, "doc": doc[first], "anchor": mix(anchor[at[first]] + np.uint64(1)), "whole": whole, "mark": (anchor[at[first]] >> np.uint64(64 - MARK_BITS)).astype(np.int64)}


def entries(found: dict[str, np.ndarray], buckets: int) -> dict[str, np.ndarray]:
    """The distinct (anchor, segment) of a pack, ordered by bucket, and which entry each segment is."""
    bucket = (found["anchor"] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((found["start"], found["whole"], found["anchor"], bucket))
    a, w = found["anchor"][order], found["whole"][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return {"first": order[new], "entry": entry, "bucket": bucket[order[new]]}


def _pack(docs: DataFrame) -> DataFrame:
    """Packs of whole documents in the order of doc_id; pack numbers follow that order. Rows of one id stay together.

    What else a row carries, ``more``, goes along in its own types.
    """
    kind = docs.schema["more"].dataType

    def run(batches):
        part, seq, ids, raws, more, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row():
            lens = np.array([len(r) for r in raws], np.int64)
            whole = pa.concat_arrays(more)
            cells = [pa.array([(part << 32) | seq]), *(pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), lens.tobytes(), b"".join(raws)))]
            return pa.RecordBatch.from_arrays([*cells, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), whole)], ["pack", "ids", "lens", "blob", "more"])

        for batch in batches:
            rest, first = batch.column("more"), 0
            for at, (i, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)):
                if size >= PACK_BYTES and i != ids[-1]:
                    more.append(rest.slice(first, at - first))
                    yield row()
                    seq, ids, raws, more, size, first = seq + 1, [], [], [], 0, at
                ids.append(i)
                raws.append(raw or b"")
                size += len(raws[-1]) + 16
            more.append(rest.slice(first))
        if ids:
            yield row()

    fields = [StructField("pack", LongType()), *(StructField(c, BinaryType()) for c in ("ids", "lens", "blob")), StructField("more", ArrayType(kind))]
    return docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, StructType(fields))


def _frequent(packs: DataFrame) -> np.ndarray:
    """Marks of the strings that are anchors in many documents of a bounded sample of packs."""
    chosen = [r.pack for r in packs.select("pack").orderBy(F.xxhash64("pack"), "pack").limit(SAMPLE_PACKS).collect()]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = segments(np.frombuffer(row.blob, np.uint8), np.frombuffer(row.lens, np.int64))
                pairs = np.unique(np.stack([found["doc"], found["mark"]], 1), axis=0)
                mark, n = np.unique(pairs[:, 1], return_counts=True)
                yield pd.DataFrame({"mark": mark, "n": n})

    counts = packs.where(F.col("pack").isin(chosen)).select("lens", "blob").mapInPandas(run, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    marks = counts.where(F.col("n") >= FREQUENT_DOCS).orderBy(F.desc("n"), "mark").limit(MOST_FREQUENT).collect()
    out = np.zeros(1 << MARK_BITS, bool)
    out[[r.mark for r in marks]] = True
    return out


def _opened(row, buckets: int, frequent: np.ndarray):
    """Bytes, ids, lengths, segments and entries of a pack."""
    flat = np.frombuffer(row.blob, np.uint8)
    ids, lens = np.frombuffer(row.ids, np.int64), np.frombuffer(row.lens, np.int64)
    found = segments(flat, lens, frequent)
    return flat, ids, lens, found, entries(found, buckets)


def _asks(packs: DataFrame, buckets: int, shared) -> DataFrame:
    """(task, bucket, pack, keys, known): the hashes of the pack's entries in that bucket, 3 bytes of the anchor and 6 of
    the segment.

    A string of a frequent anchor is asked for once a task: where an earlier pack of the task has it, its entry is only
    marked as known. A bucket of which all is known needs no answer; its row goes to any task.
    """

    def run(batches):
        held: dict[tuple[int, int], int] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                _, _, _, found, own = _opened(row, buckets, shared.value)
                first = own["first"]
                if not len(first):
                    continue
                keys = np.empty((len(first), 9), np.uint8)
                keys[:, :3] = found["anchor"][first].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :3]
                keys[:, 3:] = found["whole"][first].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
                known = np.zeros(len(first), bool)
                hot = np.flatnonzero(shared.value[found["mark"][first]])
                for j, *key in zip(hot.tolist(), found["anchor"][first[hot]].tolist(), found["whole"][first[hot]].tolist(), strict=True):
                    seen = held.get(tuple(key))
                    if seen is None and len(held) < HELD_KEYS:
                        held[tuple(key)] = row.pack
                    known[j] = seen is not None and seen < row.pack
                cut = np.flatnonzero(np.diff(own["bucket"])) + 1
                edges = [0, *cut.tolist(), len(keys)]
                spans = list(zip(edges, edges[1:], strict=False))
                bucket = own["bucket"][edges[:-1]]
                whole = np.logical_and.reduceat(known, edges[:-1])
                marks = [known[a:b].tobytes() if known[a:b].any() else None for a, b in spans]
                yield pd.DataFrame({"task": np.where(whole, -1 - row.pack % buckets, bucket), "bucket": bucket, "pack": row.pack, "keys": [keys[a:b][~known[a:b]].tobytes() for a, b in spans], "known": marks})

    return packs.select("pack", "ids", "lens", "blob").mapInPandas(run, "task long, bucket long, pack long, keys binary, known binary")


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each entry of a bucket: 1 if an earlier pack has the segment, 2 if its anchor has other segments, else 0."""
    pdf = pdf.sort_values("pack")
    sizes = pdf["keys"].str.len().to_numpy() // 9
    raw = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, 9)
    wide = np.zeros((len(raw), 16), np.uint8)
    wide[:, 5:8], wide[:, 10:] = raw[:, :3], raw[:, 3:]
    anchor, whole = wide.view(">u8").astype(np.uint64).T
    order = np.lexsort((whole, anchor))  # stable: within a segment by pack
    a, w = anchor[order], whole[order]
    same_anchor, same = np.zeros(len(a), bool), np.zeros(len(a), bool)
    same_anchor[1:] = a[1:] == a[:-1]
    same[1:] = same_anchor[1:] & (w[1:] == w[:-1])
    group = np.cumsum(~same_anchor) - 1
    several = np.bincount(group, weights=~same)[group] > 1 if len(group) else same
    status = np.empty(len(a), np.uint8)
    status[order] = np.where(same, 1, np.where(several, 2, 0))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    said = []
    for i, j, known in zip(edges, edges[1:], pdf["known"], strict=False):
        own = status[i:j]
        if known is not None:
            own = np.frombuffer(known, np.uint8).copy()
            own[own == 0] = status[i:j]
        said.append(own.tobytes())
    out = pdf[["bucket", "pack"]].assign(status=said)
    return out[[any(s) for s in out["status"]]]


def _status(own: dict[str, np.ndarray], said) -> np.ndarray:
    """The answers of all buckets in the order of the pack's entries."""
    status = np.zeros(len(own["first"]), np.uint8)
    for s in said if said is not None else ():
        lo = np.searchsorted(own["bucket"], s["bucket"])
        part = np.frombuffer(s["status"], np.uint8)
        status[lo : lo + len(part)] = part
    return status


def _open_segments(joined: DataFrame, buckets: int, shared) -> DataFrame:
    """The bytes of the entries that meet other segments of their anchor. Takes all of ``joined``, so that its exchange is
    the one that the cut reads again."""

    def run(batches):
        for batch in batches:
            for row in batch.drop_columns(["more"]).to_pandas().itertuples(index=False):
                if row.said is None:
                    continue
                flat, ids, _, found, own = _opened(row, buckets, shared.value)
                left = np.flatnonzero(_status(own, row.said) == 2)
                if len(left):
                    k = own["first"][left]
                    start, stop = found["start"][k], found["start"][k] + found["n"][k] + LENGTH - 1
                    cells = (found["anchor"][k] % np.uint64(buckets * FINER)).astype(np.int64), np.full(len(left), row.pack), left, ids[found["doc"][k]]
                    seg = pa.array([flat[i:j].tobytes() for i, j in zip(start, stop, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cells), seg], ["bucket", "pack", "entry", "doc", "seg"])

    return joined.mapInArrow(run, "bucket long, pack long, entry long, doc long, seg binary")


def previous_factors(docs: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order: the longer of the common prefixes with the nearest suffix
    before, and the nearest after, that belongs to a smaller document. lcp[i] is that of suffixes i - 1 and i."""

    def nearest(d, common):
        out, stack = [0] * len(d), []
        for i, (x, c) in enumerate(zip(d, common, strict=True)):
            while stack and stack[-1][0] >= x:
                c = min(c, stack.pop()[1])
            if stack:
                out[i] = c
            stack.append((x, c))
        return np.array(out, np.int64)

    before = nearest(docs.tolist(), lcp.tolist())
    after = nearest(docs[::-1].tolist(), np.append(lcp[1:], 0)[::-1].tolist())[::-1]
    return np.maximum(before, after)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Masks of the windows of each segment whose longest previous factor reaches LENGTH."""
    sizes = pdf["seg"].str.len().to_numpy()
    flat = np.frombuffer(b"".join(pdf["seg"]), np.uint8)
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(pdf)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + place
    wide = np.zeros((len(start), 56), np.uint8)
    wide[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[start]
    words = wide.view(">u8").astype(np.uint64)
    docs = pdf["doc"].to_numpy(np.int64)[owner]
    order = np.lexsort(words.T[::-1])
    differ = wide[order[1:], :LENGTH] != wide[order[:-1], :LENGTH]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    near = lcp >= LENGTH
    use = near | np.append(near[1:], False)  # a suffix whose neighbours share less than LENGTH can't reach it
    found = np.zeros(len(order), np.int64)
    if use.any():
        found[use] = previous_factors(docs[order][use], lcp[use])
    mask = np.zeros(len(order), np.int64)
    mask[order] = np.where(found >= LENGTH, np.int64(1), 0)
    total = np.bincount(owner, weights=(mask << place).astype(np.float64), minlength=len(pdf)).astype(np.int64)
    return pdf[["pack", "entry"]].assign(mask=total)[total != 0]


def _covered(row, buckets: int, frequent: np.ndarray):
    """Which bytes of the pack are covered."""
    flat, ids, lens, found, own = _opened(row, buckets, frequent)
    edge = np.zeros(len(flat) + 1, np.int32)
    if len(own["first"]):
        status = _status(own, row.said)
        mask = np.zeros(len(status), np.int64)
        for m in row.masks if row.masks is not None else ():
            mask[m["entry"]] = m["mask"]
        e = own["entry"]
        later = (status[e] == 1) | (ids[found["doc"]] > ids[found["doc"][own["first"]]][e])
        start, n = found["start"][later], found["n"][later]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n + LENGTH - 1, -1)
        some = np.flatnonzero(~later & (mask[e] != 0))
        for j in range(_PER):
            at = found["start"][some[(mask[e[some]] >> j) & 1 == 1]] + j
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
    return flat, ids, lens, np.cumsum(edge[:-1], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``carry``, also text, what is left (characters that a cut splits are dropped), and rest, a struct of those
    columns of ``docs`` in their own types. A null text is empty, a text under 50 bytes keeps all; a null id takes no
    part and keeps its text. Ids are numbers, or strings (earlier by their order). Rows that repeat an id are one
    document's: none is earlier than another, and they are packed together. Other columns are ignored; an empty table
    gives none.
    """
    more = F.struct(*[docs[c] for c in carry]) if carry else F.struct(F.lit(True).alias("none"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), more.alias("more"))
    ids = None
    if integral(docs, id_col):
        base = base.withColumn("doc_id", F.col("doc_id").cast("long"))
    else:
        base, ids = numbered(base, "doc_id")
        base = base.select(F.col("_n").alias("doc_id"), "text", "more")
    packs = written(_pack(base.where("doc_id is not null")), "packs")
    total = packs.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    buckets = max(8, math.ceil(total / BUCKET_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(packs))
    answers = _asks(packs, buckets, shared).groupBy("task").applyInPandas(_answer, "bucket long, pack long, status binary")
    said = written(answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "status")).alias("said")), "answers")
    joined = packs.join(said, "pack", "left")
    masks = _open_segments(joined, buckets, shared).groupBy("bucket").applyInPandas(_compare, "pack long, entry long, mask long")
    masks = masks.groupBy("pack").agg(F.collect_list(F.struct("entry", "mask")).alias("masks"))

    def cut(batches):
        for batch in batches:
            rest = batch.column("more")
            for at, row in enumerate(batch.drop_columns(["more"]).to_pandas().itertuples(index=False)):
                flat, ids, lens, gone = _covered(row, buckets, shared.value)
                out, lo = [], 0
                for i, n in zip(ids.tolist(), lens.tolist(), strict=True):
                    g = gone[lo : lo + n]
                    kept = flat[lo : lo + n][~g].tobytes()
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (n > 0 and g[0]))
                    out.append((i, n, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if carry else None))
                    lo += n
                cells = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.string(),) * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([*cells, rest[at].values], columns)

    kind = base.schema["more"].dataType
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "rest"]
    fields = [*(StructField(c, LongType()) for c in columns[:4]), *(StructField(c, StringType()) for c in columns[4:6]), StructField("rest", kind)]
    out = joined.join(masks, "pack", "left").mapInArrow(cut, StructType(fields))
    raw = F.encode("text", "UTF-8")
    none = F.lit(0).cast("long")
    out = out.unionByName(base.where("doc_id is null").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), "text", F.col("more").alias("rest")))
    if ids is not None:
        out = out.join(ids.withColumnRenamed("_n", "doc_id"), "doc_id", "left").select(F.col("_id").alias("doc_id"), *columns[1:])
    return out if carry else out.drop("text", "rest")


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeats cut out of their texts; one that nothing is left of goes. Columns are as in ``docs``, with
    their values and types; a null text that stays is empty."""
    own, names = apart(docs)
    id_, text = names[id_col], names[text_col]
    out = remove_repeats(own, id_col=id_, text_col=text, carry=[c for c in own.columns if c != text])
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    return together(out.select(*[(F.col("text") if c == text else F.col("rest").getField(c)).alias(c) for c in own.columns]), names)
