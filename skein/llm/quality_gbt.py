"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes ``FEATURES`` statistics of its bytes, words and lines.  Trees of fixed depth are
grown on quantile bins by logistic gradients and kept as flat arrays, which numpy walks for all rows
of a batch at once.  Labels are learnt only from rows whose ``crc32(id as text) mod 5`` is not 0, of
which at most ``max_rows`` (by hash of the id) are taken; labels, lang, source and id are no inputs.

Defined edge cases: null and empty texts have all statistics 0 and are scored like any other;
duplicate or null labels: the largest label of an id counts, null ones are ignored; with fewer than
two classes in the training rows every score is their mean (0.5 with none); repeated rows stay
repeated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_COEF, ascii_lower, mix, word_chunks

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "newline", "stop", "comma", "bang", "symbol", "bar", "non_ascii", "other_ascii",
    "distinct_words", "top_word", "same_as_last", "distinct_pairs", "top_pair", "distinct_triples", "line_bytes", "repeated_lines",
)
#: Classes of bytes: upper, lower, digit, space, newline, full stop and ?, comma and ;:, !, symbols, |, beyond ASCII, the rest.
_CLASS = np.full(256, 11, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 0, 1, 2, 3, 4
_CLASS[[46, 63]], _CLASS[[44, 58, 59]], _CLASS[33], _CLASS[[*b"#$%&*+<=>@\\^_`~{}[]"]], _CLASS[124], _CLASS[128:] = 5, 6, 7, 8, 9, 10


def _top_share(x: np.ndarray) -> tuple[float, float]:
    """Distinct share, and share of the most frequent value."""
    if not len(x):
        return 0.0, 0.0
    s = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    return (len(at) - 1) / len(x), float(np.diff(at).max()) / len(x)


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, h, cut in word_chunks(texts, ascii_lower):
        for k in range(len(cut) - 1):
            t = texts[a + k]
            if not t:
                continue
            raw, w = t.encode("utf-8", "surrogatepass"), h[cut[k] : cut[k + 1]]
            n, m = len(raw), len(w)
            c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=12) / n
            distinct, top = _top_share(w)
            pairs = w[:-1] * WORD_COEF[0] + w[1:] * WORD_COEF[1]
            p_distinct, p_top = _top_share(pairs)
            triples = mix(pairs[:-1] * WORD_COEF[2] + w[2:]) if m > 2 else w[:0]
            lines = [x for x in t.split("\n") if x]
            out[a + k] = (
                np.log1p(n), np.log1p(m), n / max(1, m), c[0], c[2], c[3], c[4], c[5], c[6], c[7], c[8], c[9], c[10], c[11],
                distinct, top, float((w[1:] == w[:-1]).mean()) if m > 1 else 0.0, p_distinct, p_top, _top_share(triples)[0],
                np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
            )
    return out


class Trees:
    """Boosted trees as arrays: node ``i`` of a tree has children ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((len(leaf)).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            margin += leaf[at - len(f)]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0) -> Trees:
    """Grow trees level by level on histograms of gradients."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    mean = float(y.mean()) if n else 0.5
    if n == 0 or mean in (0.0, 1.0):
        odds = 0.0 if n == 0 else (8.0 if mean == 1.0 else -8.0)
        return Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), odds)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(k)]
    b = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    base = float(np.log(mean / (1 - mean)))
    margin, inner = np.full(n, base), 2**depth - 1
    fs, cs, ls = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, w = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, int)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best, where = np.full(wide, 1e-9), [(0, -1)] * wide
            for f in range(k):
                cell = (at - first) * bins + b[:, f]
                gs = np.bincount(cell, g, wide * bins).reshape(wide, bins).cumsum(1)
                ws = np.bincount(cell, w, wide * bins).reshape(wide, bins).cumsum(1)
                ga, wa = gs[:, -1:], ws[:, -1:]
                gain = gs**2 / (ws + ridge) + (ga - gs) ** 2 / (wa - ws + ridge) - ga**2 / (wa + ridge)
                gain[:, len(edges[f]) :] = 0
                j = gain.argmax(1)
                for q in np.flatnonzero(gain[np.arange(wide), j] > best):
                    best[q], where[q] = gain[q, j[q]], (f, j[q])
            for q, (f, j) in enumerate(where):
                if j >= 0:
                    feature[first + q], cut[first + q] = f, edges[f][j]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        gs, ws = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, w, inner + 1)
        leaf = -rate * gs / (ws + ridge)
        margin += leaf[at - inner]
        fs.append(feature)
        cs.append(cut)
        ls.append(leaf)
    return Trees(np.array(fs), np.array(cs), np.array(ls), base)


def fold(id_: Column) -> Column:
    """``crc32(id as text) mod 5``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, max_rows: int) -> DataFrame:
    """``(text, label)`` of at most ``max_rows`` labelled rows outside fold 0, first by hash of the id."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("k").isNotNull() & (fold(F.col("k")) != 0))
    known = known.groupBy("k").agg(F.max("label").alias("label")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(known), "k").select("text", "label")  # max_rows bounds it


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``."""
    spark = docs.sparkSession

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": list(statistics(pdf["text"].tolist())), "label": pdf["label"]})

    rows = training_rows(docs, labels, id_col, text_col, label, max_rows).mapInPandas(measure, "x array<double>, label int").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(rows) else slice(None)
    model = spark.sparkContext.broadcast(fit(x[order], rows["label"].to_numpy(float)[order]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "score": model.value.predict(statistics(pdf["text"].tolist()))})

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (fold(F.col(id_col)) == 0).alias("held_out")).mapInPandas(score, "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
