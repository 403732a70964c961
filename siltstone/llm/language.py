"""Language identification: a byte convolutional network, trained in numpy, applied to fixed-length windows."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm.common import apart, fold, together, written

WIDTHS = (2, 3, 4, 5)
FILTERS = 8
LENGTH = 128
#: Labelled rows that training reads of a language, and of all languages together (each has as many, and 8 at least), in
#: the order of a hash of the id; and the windows of these that it learns from, drawn by a hash from the whole texts.
ROWS_A_LANGUAGE, ROWS = 400, 40_000
WINDOWS_A_LANGUAGE, WINDOWS = 8_000, 64_000
#: How sure the pipeline's stage must be; of four languages, a score of 0.3.
SURE = 1 / 15
_LETTER = re.compile(r"[^\W\d_]")
_STEP = 256


def windows(text: str) -> np.ndarray:
    """The whole text as rows of LENGTH bytes; the last one is padded by zeros."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // LENGTH)), LENGTH), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


class ByteCnn:
    """Filters over one-hot bytes (tables indexed by byte), max pooling over the window, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _features(self, x: np.ndarray, where: bool = False):
        pooled, at = [], []
        for table, bias in zip(self.tables, self.bias, strict=True):
            n = LENGTH - len(table) + 1
            total = table[0][x[:, :n]]
            for j in range(1, len(table)):
                total += table[j][x[:, j : j + n]]
            if where:
                at.append(total.argmax(1))
            pooled.append(np.maximum(total.max(1) + bias, 0))
        return np.concatenate(pooled, 1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), _STEP):
            z = self._features(x[i : i + _STEP])[0] @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 0.01, batch: int = 128, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        f, step = np.arange(FILTERS), 0
        weight = len(y) / (len(self.labels) * np.maximum(np.bincount(y, minlength=len(self.labels)), 1))
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xb, yb = x[rows], y[rows]
                h, at = self._features(xb, True)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= (weight[yb] / len(yb)).astype(np.float32)[:, None]
                back = (p @ self.out.T) * (h > 0)
                grads = []
                for k, table in enumerate(self.tables):
                    g, d = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(table)
                    for j in range(len(table)):
                        np.add.at(d[j], (np.take_along_axis(xb, at[k] + j, 1), f[None, :]), g)
                    grads.append(d)
                grads += [back.reshape(len(yb), len(WIDTHS), FILTERS).sum(0), h.T @ p, p.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            rate *= 0.7


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_a_language: int) -> DataFrame:
    """(l, x): windows of a bounded, reproducible sample of labelled rows that are not held out, in a fixed order."""
    space = 1 << 30
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where((fold("i", 3) != 1) & F.col("l").isNotNull() & F.col("i").isNotNull() & (F.length("t") > 0))
    known = known.withColumn("h", F.pmod(F.xxhash64("i"), F.lit(space)))
    sizes = written(known.groupBy("l").agg(F.count("*").alias("n")), "languages")
    languages = max(1, sizes.count())
    rows, most = (min(a, max(8, b // languages)) for a, b in ((rows_a_language, ROWS), (WINDOWS_A_LANGUAGE, WINDOWS)))
    near = known.join(sizes, "l").where(F.col("h") < F.ceil(F.lit(space) * 2.0 * rows / F.col("n")) + space * 64 / F.col("n"))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "t"))).where(F.col("r") <= rows).select("l", "h", "i", "t")

    def cut(batches):
        for pdf in batches:
            for lang, h, text in zip(pdf["l"], pdf["h"], pdf["t"], strict=True):
                if _LETTER.search(text):
                    x = windows(text)
                    yield pd.DataFrame({"l": lang, "h": h, "at": np.arange(len(x)), "x": [w.tobytes() for w in x]})

    pieces = first.mapInPandas(cut, "l string, h long, at long, x binary")
    order = Window.partitionBy("l").orderBy(F.xxhash64("h", "at"), "h", "at", "x")
    return pieces.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).orderBy("l", "r").select("l", "x")


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_a_language: int = ROWS_A_LANGUAGE) -> ByteCnn | None:
    """A network trained on a bounded sample of labelled rows; None where no labelled row has letters."""
    found = training_windows(docs, id_col, text_col, lang_col, rows_a_language).toArrow().to_pandas()
    if not len(found):
        return None
    labels = sorted(set(found["l"]))
    net = ByteCnn(labels)
    x = np.frombuffer(b"".join(found["x"]), np.uint8).reshape(-1, LENGTH)
    net.train(x, np.searchsorted(labels, found["l"].tolist()))
    return net


def predict(docs: DataFrame, net: ByteCnn | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score: the mean of the windows' probabilities, over the whole text.

    A null text, or one without letters, gets 'und' and 0; without a network so does every row. Equal probabilities
    go to the first label in sorted order. Every column of ``docs`` is kept; columns that are already named
    lang_pred or score are replaced. No shuffle.
    """
    docs = docs.drop("lang_pred", "score")
    own, names = apart(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def guess(texts: pd.Series) -> pd.DataFrame:
        net = shared.value
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [] if net is None else [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        at = 0
        while at < len(rows):
            part, n = [], 0
            start = at
            while at < len(rows) and n < 8192:
                part.append(windows(texts.iloc[rows[at]]))
                n += len(part[-1])
                at += 1
            p = net.probabilities(np.concatenate(part))
            sizes = [len(x) for x in part]
            mean = np.add.reduceat(p, np.concatenate(([0], np.cumsum(sizes)[:-1])), 0) / np.array(sizes)[:, None]
            for i, m in zip(rows[start:at], mean, strict=True):
                lang[i], score[i] = net.labels[int(m.argmax())], min(1.0, float(m.max()))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    found = F.pandas_udf(guess, "lang_pred string, score double")
    out = own.withColumn("guess", found(F.col(names[text_col])))
    return out.select(*[F.col(d).alias(c) for c, d in names.items()], "guess.lang_pred", "guess.score")


def keep_known(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sure: float = SURE) -> DataFrame:
    """The documents with a language: those with letters whose score is at least ``sure`` of the way from a blind guess
    among the learned languages to certainty. Other rows, of null or empty texts or without letters, go; repeated rows
    are judged alike. Where no row is labelled there is nothing to learn from, and every document stays.
    """
    net = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if net is None:
        return docs
    least = (1 + sure * (len(net.labels) - 1)) / len(net.labels) if len(net.labels) > 1 else 0.0
    own, names = apart(docs)
    found = predict(own, net, text_col=names[text_col])
    return together(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), names)
