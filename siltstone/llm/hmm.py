"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by scaled forward recursion.

The states emit word classes. The HMM_WORDS most frequent training words are classes of their own; every other word
belongs to one of TAIL_CLASSES by hash, in which it has probability (c + 1) / (C + V + 1) by its count (one share is
left for the class's unseen words). So a text's probability is that of its class sequence, by the recursion, times
those of its words within their classes, and sums to one over all texts. What is sent to the workers (a fixed number
of words of limited length, the states' tables) has a fixed bound; counts of rarer words are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import fold, written

STATES = 6
#: Rounds of Baum-Welch, after so many in which whole texts are assigned to states.
ROUNDS, START_ROUNDS = 3, 2
HMM_WORDS = 1 << 14
TAIL_CLASSES = 1 << 10
#: The most frequent words, whose counts workers look up by themselves. A word over WORD_BYTES goes by its digest.
KNOWN_WORDS = 1 << 17
WORD_BYTES = 48
#: Weight, in tokens, of the overall distribution in each state's.
PRIOR = 2000.0
#: Tokens of a chunk: longer texts are cut into chunks that are computed side by side, each from the state in which the
#: one before leaves it (and to that in which the next begins), so that nothing is lost at a cut. Tokens in work at a time.
CHUNK, TRAIN_TOKENS = 2048, 600_000
#: Different words that counting holds at a time, and tokens that scoring does (a longer text is held by itself).
HELD_WORDS, SCORE_TOKENS = 250_000, 2_000_000
END = HMM_WORDS + TAIL_CLASSES
CLASSES = END + 1


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; a long one as its digest, which no word equals."""
    words = (text or "").encode().lower().split()
    if max(map(len, words), default=0) > WORD_BYTES:
        words = [w if len(w) <= WORD_BYTES else b"\t" + hashlib.md5(w).digest() for w in words]
    return words


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of falling length: active sequences by step, first row of each step, row of each token."""
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    first = np.concatenate(([0], np.cumsum(active)))
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return active, first, first[step] + np.repeat(np.arange(len(lengths)), lengths)


def _laid(ids: np.ndarray, lengths: np.ndarray):
    """Sequences by falling length, step after step: their order, active, first and row of ``time_major``, laid ids."""
    order = np.argsort(-lengths, kind="stable")
    parts = np.split(ids, np.cumsum(lengths)[:-1])
    active, first, row = time_major(lengths[order])
    laid = np.empty(len(ids), np.int32)
    laid[row] = np.concatenate([parts[i] for i in order])
    return order, active, first, row, laid


def forward(ids: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool = False):
    """Scaled forward recursion over sequences that lie one after the other; log10 likelihood of each (and its parts).
    ``start`` is one distribution, or a row a sequence."""
    order, active, first, row, laid = _laid(ids, lengths)
    fall = lengths[order]
    scale = np.empty(len(ids), emit.dtype)
    alpha = np.empty((len(ids), len(move)), emit.dtype) if keep else None
    a = None
    for t, m in enumerate(active):
        lo = first[t]
        a = ((start if start.ndim == 1 else start[order]) if a is None else a[:m] @ move) * emit[laid[lo : lo + m]]
        s = a.sum(1)
        a /= s[:, None]
        scale[lo : lo + m] = s
        if keep:
            alpha[lo : lo + m] = a
    logs = np.zeros(len(lengths))
    logs[order] = np.add.reduceat(np.log10(scale[row].astype(np.float64)), np.cumsum(fall) - fall)
    return (logs, order, laid, scale, alpha, active, first) if keep else logs


def expected(ids: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Baum-Welch: expected starts, moves and emissions of the sequences.

    For chunks of longer texts, ``before`` is the state distribution that each one follows (NaN where a text begins)
    and ``after`` the likelihood, by last state, of what follows.
    """
    _, order, laid, scale, alpha, active, first = forward(ids, lengths, start, move, emit, True)
    k = len(move)
    last = np.ones((len(lengths), k), emit.dtype) if after is None else after[order].astype(emit.dtype)
    moves = np.zeros(move.shape)
    gamma = np.empty_like(alpha)
    beta = last[:0]
    for t in range(len(active) - 1, -1, -1):
        lo, m = first[t], active[t]
        if len(beta) < m:  # these end here
            ends = last[len(beta) : m]
            beta = np.concatenate([beta, ends / (alpha[lo + len(beta) : lo + m] * ends).sum(1, keepdims=True)])
        gamma[lo : lo + m] = alpha[lo : lo + m] * beta
        back = beta * emit[laid[lo : lo + m]] / scale[lo : lo + m, None]
        if t:
            moves += alpha[first[t - 1] : first[t - 1] + m].T @ back
            beta = back @ move.T
    begins = np.ones(len(order), bool)
    if before is not None:
        begins = np.isnan(before[order, 0])
        moves += before[order][~begins].T @ back[~begins]
    emits = np.stack([np.bincount(laid, gamma[:, j], CLASSES) for j in range(k)])
    return gamma[: active[0]][begins].sum(0).astype(float), moves * move, emits


def transfers(ids: np.ndarray, lengths: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """(sequence, state before its first token, state of its last): likelihoods up to a factor a sequence."""
    order, active, first, _, laid = _laid(ids, lengths)
    k = len(move)
    a = np.zeros((len(lengths), k, k), emit.dtype)
    a[:, range(k), range(k)] = emit[laid[: active[0]]]
    for t, m in enumerate(active):
        if t:
            a[:m] = (a[:m] @ move) * emit[laid[first[t] : first[t] + m], None]
        a[:m] /= a[:m].sum((1, 2), keepdims=True)
    out = np.empty_like(a)
    out[order] = a
    return out


def chunked(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, size: int, chunk: int | None = None):
    """Batches of about ``size`` tokens of chunks of the sequences: (sequence of each chunk, ids, lengths, start rows,
    before, after), such that ``forward`` and ``expected`` of the chunks sum up to those of whole sequences."""
    chunk, k = chunk or CHUNK, len(move)
    parts = [s[lo : lo + chunk] for s in seqs for lo in range(0, len(s), chunk)]
    owner = np.repeat(np.arange(len(seqs)), [-(-len(s) // chunk) for s in seqs])
    lengths = np.array([len(p) for p in parts])
    enter = np.broadcast_to(start, (len(parts), k)).astype(emit.dtype)
    before, after = np.full((len(parts), k), np.nan, emit.dtype), np.ones((len(parts), k), emit.dtype)
    several = np.flatnonzero(np.bincount(owner)[owner] > 1)
    step = max(1, size // chunk)
    batches = [several[lo : lo + step] for lo in range(0, len(several), step)]
    through = [m for some in batches for m in transfers(np.concatenate([parts[i] for i in some]), lengths[some], move, emit)]
    for p, i in enumerate(several):
        if p and owner[several[p - 1]] == owner[i]:
            before[i], enter[i] = leave, leave @ move
        leave = enter[i] @ through[p]
        leave = leave / leave.sum()
    for p in range(len(several) - 2, -1, -1):
        i, j = several[p], several[p + 1]
        if owner[i] == owner[j]:
            ahead = move @ (through[p + 1] @ after[j])
            after[i] = ahead / ahead.sum()
    lo, held = 0, 0
    for hi, n in enumerate(lengths, 1):
        held += n
        if held >= size or hi == len(parts):
            yield owner[lo:hi], np.concatenate(parts[lo:hi]), lengths[lo:hi], enter[lo:hi], before[lo:hi], after[lo:hi]
            lo, held = hi, 0


class Vocabulary:
    """What workers know of the words: classes and counts of frequent ones, sizes of the tail's classes."""

    def __init__(self, words: list[tuple[bytes, int]], tail: dict[int, tuple[int, int]], total: int, distinct: int, documents: int):
        self.index = {w: i for i, (w, _) in enumerate(words)}
        self.logs = np.log10(np.array([c for _, c in words], float) + 1)
        self.own = np.array([i if i < HMM_WORDS else _tail_class(w) for i, (w, _) in enumerate(words)] + [0], np.int32)
        self.total, self.distinct, self.documents = total, distinct, documents
        share = np.zeros(TAIL_CLASSES)
        for k, (c, v) in tail.items():
            share[k] = c + v
        self.room = np.log10(share + 1)
        first = min(len(words), HMM_WORDS)
        mass = np.ones(CLASSES)
        mass[:first] += [c for _, c in words[:HMM_WORDS]]
        mass[first:HMM_WORDS] = 0
        mass[HMM_WORDS:END] += [tail.get(k, (0, 0))[0] for k in range(TAIL_CLASSES)]
        mass[END] += documents
        self.prior = mass / mass.sum()

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the known ones, or -1."""
        get = self.index.get
        return np.array([get(w, -1) for w in words], np.int32)

    def classes(self, words: list[bytes], at: np.ndarray | None = None) -> np.ndarray:
        """The class sequence of a text, its end included."""
        at = self.find(words) if at is None else at
        out = np.append(self.own[at], np.int32(END))
        rare = np.flatnonzero(at < 0)
        out[rare] = [HMM_WORDS + zlib.crc32(words[i]) % TAIL_CLASSES for i in rare.tolist()]
        return out


def _tail_class(word: bytes) -> int:
    return HMM_WORDS + zlib.crc32(word) % TAIL_CLASSES


def _frequent(counts: DataFrame) -> DataFrame:
    """About KNOWN_WORDS of the most frequent words: those above a count, and of those near it as many by a hash."""
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()  # 1,024 rows at most
    room = KNOWN_WORDS
    for r in sizes:
        if r.n > room:
            share = math.floor(room / r.n * (1 << 30))
            return counts.where((step > r.s) | ((step == r.s) & (F.pmod(F.xxhash64("w"), F.lit(1 << 30)) < share)))
        room -= r.n
    return counts


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """``counts(w, c)`` as far as workers know it."""
    every = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = sorted(((bytes(r.w), r.c) for r in _frequent(counts).collect()), key=lambda x: (-x[1], x[0]))
    frequent = [(w,) for w, _ in words[:HMM_WORDS]]
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame(frequent, "w binary")), "w", "left_anti") if frequent else counts
    tail = rest.groupBy((F.crc32("w") % TAIL_CLASSES).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    return Vocabulary(words, {r.k: (r.c, r.v) for r in tail}, every[0] + documents, every[1] + (documents > 0), documents)


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c) over ``texts(text)``: summed by batch, then by word."""

    def run(batches):
        for pdf in batches:
            found: Counter[bytes] = Counter()
            for text in pdf["text"]:
                found.update(tokens(text))
                if len(found) >= HELD_WORDS:
                    yield pd.DataFrame({"w": list(found), "c": list(found.values())})
                    found = Counter()
            if found:
                yield pd.DataFrame({"w": list(found), "c": list(found.values())})

    return texts.select("text").mapInPandas(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _encoded(texts: DataFrame, known) -> DataFrame:
    """(ids): the class sequence of each text, two bytes a token, written: the rounds read it instead of the texts."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"ids": [known.value.classes(tokens(text)).astype(np.uint16).tobytes() for text in pdf["text"]]})

    return written(texts.select("text").mapInPandas(run, "ids binary"), "classes")


def _summed(encoded: DataFrame, size: int, add) -> np.ndarray:
    """(CLASSES + STATES + 1, STATES): what ``add(sums, sequences)`` gathers over every text, emissions by class, moves and
    starts. Summed in each task before it is shuffled."""

    def run(batches):
        sums = np.zeros((CLASSES + STATES + 1, STATES))
        seqs, n = [], 0
        for pdf in batches:
            for ids in pdf["ids"]:
                seqs.append(np.frombuffer(ids, np.uint16))
                n += len(seqs[-1])
                if n >= size:
                    add(sums, seqs)
                    seqs, n = [], 0
        if seqs:
            add(sums, seqs)
        some = np.flatnonzero(sums.any(1))
        yield pd.DataFrame({"k": some, **{f"s{j}": sums[some, j] for j in range(STATES)}})

    fields = [f"s{j}" for j in range(STATES)]
    out = encoded.mapInPandas(run, "k long, " + ", ".join(f"{f} double" for f in fields))
    out = out.groupBy("k").agg(*[F.sum(f).alias(f) for f in fields]).toPandas().set_index("k")[fields]
    return out.reindex(range(CLASSES + STATES + 1), fill_value=0.0).to_numpy()


def _starting(encoded: DataFrame, vocab: Vocabulary):
    """States from every text: each one belongs to that of STATES random tilts of the overall distribution under which it
    is the likeliest, so that texts of the same frequent words come together; then to the nearest of those groups' counts."""
    emit = np.random.default_rng(5).normal(0, 1, (CLASSES, STATES))
    for _ in range(START_ROUNDS):
        logs = encoded.sparkSession.sparkContext.broadcast(np.ascontiguousarray(emit, np.float32))

        def add(sums, seqs, logs=logs):
            owner = np.cumsum([len(s) for s in seqs])
            ids = np.concatenate(seqs)
            state = np.add.reduceat(logs.value[ids], np.r_[0, owner[:-1]], 0, np.float64).argmax(1)
            for k in range(STATES):
                sums[:CLASSES, k] += np.bincount(ids[np.repeat(state == k, np.diff(np.r_[0, owner]))], minlength=CLASSES)

        counts = _summed(encoded, TRAIN_TOKENS, add)[:CLASSES] + PRIOR * vocab.prior[:, None]
        share = counts / counts.sum(0)
        emit = np.log(share.clip(1e-300) / vocab.prior[:, None].clip(1e-300)).clip(-20, 20)
    return np.full(STATES, 1 / STATES), np.where(np.eye(STATES) > 0, 0.98, 0.02 / max(STATES - 1, 1)), share.T


def train(texts: DataFrame, vocab: Vocabulary, rounds: int | None = None):
    """(start, move, emit) after ``rounds`` of Baum-Welch over every text of ``texts(text)``. Null and empty texts are
    their ends; without texts the states are alike."""
    if not vocab.documents:
        return np.full(STATES, 1 / STATES), np.full((STATES, STATES), 1 / STATES), np.tile(vocab.prior, (STATES, 1))
    sc = texts.sparkSession.sparkContext
    encoded = _encoded(texts, sc.broadcast(vocab))
    start, move, emit = _starting(encoded, vocab)
    for _ in range(ROUNDS if rounds is None else rounds):
        model = sc.broadcast((start.astype(np.float32), move.astype(np.float32), np.ascontiguousarray(emit.T, np.float32)))

        def add(sums, seqs, model=model):
            begin, move, emit = model.value
            for _, ids, lengths, enter, before, after in chunked(seqs, begin, move, emit, TRAIN_TOKENS):
                starts, moves, emits = expected(ids, lengths, enter, move, emit, before, after)
                sums += np.concatenate([emits.T, moves, starts[None]])

        rows = _summed(encoded, TRAIN_TOKENS, add)
        emit = rows[:CLASSES].T + PRIOR * vocab.prior
        emit /= emit.sum(1, keepdims=True)
        move = rows[CLASSES : CLASSES + STATES] + 0.1
        move /= move.sum(1, keepdims=True)
        start = rows[-1] + 0.1
        start /= start.sum()
    return start, move, emit


def _held_out(id_: Column, held: tuple[int, int]) -> Column:
    return F.coalesce(fold(id_, held[0]) == held[1], F.lit(True))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (7, 2)) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(id) modulo held[0] is not held[1] (a null id is held out). A null or empty
    text is its end alone. Without training documents the base has one share for the unseen, so its scores are 0.
    Rows that repeat an id each give a row. Other columns are ignored; an empty table gives none.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _held_out(F.col(id_col), held).alias("held_out"))
    texts = base.where("not held_out")
    counts = written(word_counts(texts), "words")
    vocab = vocabulary(counts, texts.count())
    start, move, emit = train(texts, vocab)
    sc = docs.sparkSession.sparkContext
    known, model = sc.broadcast(vocab), sc.broadcast((start, move, np.ascontiguousarray(emit.T)))
    share = math.log10(vocab.total + vocab.distinct + 1)

    names = ["row", "doc_id", "w", "tf", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        vocab, state = known.value, model.value
        ended = math.log10(vocab.documents + 1)

        def flush(batch, rows, seqs, rare):
            at, n_known, base, within = map(np.array, zip(*rows, strict=True))
            for owner, ids, lengths, enter, *_ in chunked(seqs, *state, SCORE_TOKENS):
                within += np.bincount(owner, forward(ids, lengths, enter, *state[1:]), len(seqs))
            row = batch.column("row").take(pa.array(at))
            # no word starts with a space: this key matches no count, and spreads over the tasks of the join
            key = pa.array([b" %d" % i for i in row.to_pylist()], pa.binary())
            ones = pa.array(np.ones(len(at), np.int64))
            cells = [row, batch.column("doc_id").take(pa.array(at)), key, ones, pa.array(np.array([len(s) for s in seqs], np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(within)]
            yield pa.RecordBatch.from_arrays(cells, names)
            # rare words: a row each, counted by text
            n = np.array([len(r) for r in rare], np.int64)
            if n.sum():
                w, tf = pa.array([w for r in rare for w in r], pa.binary()), pa.array([c for r in rare for c in r.values()], pa.int64())
                zero, none = pa.array(np.zeros(n.sum(), np.int64)), pa.nulls(n.sum(), batch.column("doc_id").type)
                cells = [row.take(pa.array(np.repeat(np.arange(len(n)), n))), none, w, tf, zero, zero, zero.cast(pa.float64()), zero.cast(pa.float64())]
                yield pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            rows, seqs, rare, held = [], [], [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = tokens(text)
                at = vocab.find(words)
                ids = vocab.classes(words, at)
                logs, tail = vocab.logs[at[at >= 0]], ids[:-1] >= HMM_WORDS
                within = float(vocab.logs[at[at >= HMM_WORDS]].sum()) - float(vocab.room[ids[:-1][tail] - HMM_WORDS].sum())
                rows.append((i, len(logs) + (vocab.documents > 0), float(logs.sum()) + ended - share * len(ids), within))
                seqs.append(ids)
                rare.append(Counter([words[j] for j in np.flatnonzero(at < 0).tolist()]))
                held += len(ids)
                if held >= SCORE_TOKENS:
                    yield from flush(batch, rows, seqs, rare)
                    rows, seqs, rare, held = [], [], [], 0
            if rows:
                yield from flush(batch, rows, seqs, rare)

    numbered = base.withColumn("row", F.monotonically_increasing_id())
    kind = base.schema["doc_id"].dataType.simpleString()
    parts = numbered.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, w binary, tf long, n_tokens long, n_known long, base_score double, score double")
    parts = parts.join(counts, "w", "left")
    seen = F.coalesce(F.col("tf") * F.log10(F.col("c") + 1), F.lit(0.0))
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"), F.sum(F.col("base_score") + seen).alias("base_score"), F.sum(F.col("score") + seen).alias("score"))
    return sums.select("doc_id", _held_out(F.col("doc_id"), held).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
