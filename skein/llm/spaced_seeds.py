"""Benchmark decontamination by spaced seeds: hashes of masked word windows, verified around each hit.

Words are lower-cased and lose ASCII punctuation.  A seed is a mask over a window of words; positions
under a 0 are ignored, so a seed still hits where a word there was substituted.  Every hit of a
benchmark item on a document fixes a diagonal, along which item and document words are compared.  Of items up to ``WHOLE`` words
all matches of the diagonal count; of longer ones those in windows of 16 words with 13 matches, and those in runs that score well (a
match 1, a mismatch -3).  An item is found where the words so matched, over all diagonals, are at least ``min(min_words,
ceil(share * words of the item))``.  At the default share the masks hit every item of up to 16 words, and every window of 16 words of a
longer one, that has a fifth of its words substituted, wherever they stand.

The benchmark is a query set held against all rows: it is read in blocks of bounded bytes, each block's
seeds are broadcast, and every document is scanned whole.

Defined edge cases: null or empty texts contain nothing; items with fewer than ``min_item`` words are
ignored (they would mark ordinary prose), items shorter than the masks get masks over their whole length that
ignore every one of their words in turn (from 10 words on every two), those under 5 words are, if ``min_item``
admits them, looked for verbatim; an item without an id is looked for too and listed as null, last; null item texts are ignored; repeated rows stay repeated; with no benchmark no document is
marked; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_COEF, durable, mix, word_chunks

#: Weight 6.  Chosen greedily so that one of them hits whichever two of 12 to 14 words, or three of 15 or 16, are substituted (tested).
MASKS = ("1111011", "11010001011", "1100011011", "1111101")
#: Items of fewer words get masks of their own; items of more than ``WHOLE`` are too long for all of a diagonal to count.
LONGEST, WHOLE = 12, 40
WINDOW, IN_WINDOW = 16, 13
BLOCK_BYTES = 8 << 20
_DROP = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def bare(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _DROP)


def short_masks(n: int) -> list[str]:
    """Masks over the whole of an item of ``n`` words: no word ignored, one, or (from 10 words on) two."""
    ignored = [(), *((i,) for i in range(n)), *((i, j) for i in range(n) for j in range(i + 1, n) if n >= 10)]
    return ["".join("0" if i in out else "1" for i in range(n)) for out in ignored]


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the masked window at each word where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return h[:0]
    out = np.full(n, int(WORD_COEF[63]) * (2 * salt + 1) % 2**64, U64)
    for j, c in enumerate(mask):
        if c == "1":
            out += h[j : j + n] * WORD_COEF[j]
    return mix(out)


class Index:
    """Seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], min_item: int):
        hashes = [(i, h[cut[k] : cut[k + 1]]) for a, h, cut in word_chunks([t for _, t in items], bare) for k, (i, _) in enumerate(items[a : a + len(cut) - 1])]
        hashes = [(i, h) for i, h in hashes if len(h) >= min_item]
        self.ids, self.words = [i for i, _ in hashes], [h for _, h in hashes]
        self.masks = list(MASKS) + [m for n in sorted({len(h) for h in self.words if len(h) < LONGEST}) for m in (short_masks(n) if n > 4 else ["1" * n])]
        keys, where = [], []
        for k, h in enumerate(self.words):
            for m, mask in enumerate(self.masks):
                s = seeds(h, mask, m) if m < len(MASKS) or len(mask) == len(h) else h[:0]
                keys.append(s)
                where.append(np.stack([np.full(len(s), k), np.arange(len(s))], 1))
        key = np.concatenate(keys) if keys else np.zeros(0, U64)
        at = np.argsort(key, kind="stable")
        self.key, self.where = key[at], (np.concatenate(where)[at] if where else np.zeros((0, 2), int))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.key >> U64(42)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word of the text, item, word of the item) of all hits of a mask at once, for words ``h`` of some texts."""
        for m, mask in enumerate(self.masks):
            s = seeds(h, mask, m)
            p = np.flatnonzero(self.bits[s >> U64(42)])
            if not len(p):
                continue
            lo, hi = np.searchsorted(self.key, s[p], "left"), np.searchsorted(self.key, s[p], "right")
            n = hi - lo
            if n.any():
                e = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield np.repeat(p, n), self.where[e, 0], self.where[e, 1]


def good_runs(same: np.ndarray, least: int = 6) -> list[tuple[int, int]]:
    """Runs in which matches outweigh mismatches by three to one at least, with ``least`` matches."""
    out, at, n = [], 0, len(same)
    while at < n:
        if not same[at]:
            at += 1
            continue
        score = best = 0
        end = k = at
        while k < n and score >= 0:
            score += 1 if same[k] else -3
            k += 1
            if score > best:
                best, end = score, k
        if same[at:end].sum() >= least:
            out.append((at, end))
        at = max(end, at + 1)
    return out


def counted(same: np.ndarray, item: int) -> np.ndarray:
    """The matches of a diagonal that count for an item of so many words."""
    if item <= WHOLE:
        return same
    inside = np.zeros(len(same), bool)
    for x, y in good_runs(same):
        inside[x:y] = True
    sums = np.concatenate(([0], np.cumsum(same)))
    for x in np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= IN_WINDOW):
        inside[x : x + WINDOW] = True
    return same & inside


def scan(index, min_words: int, share: float):
    """Batches of (id, text) to (id, items, matched): the items found, and the largest share of one that is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for pdf in batches:
            texts, found = pdf["text"].tolist(), [([], 0.0)] * len(pdf)
            for a, h, cut in word_chunks(texts, bare):
                lines = defaultdict(list)
                length = np.array([len(w) for w in ix.words], np.int64)
                diagonals = [np.zeros((0, 3), np.int64)]
                for p, k, j in ix.hits(h):
                    d = np.searchsorted(cut, p, "right") - 1
                    own = p - j + length[k] > cut[d]
                    diagonals.append(np.unique(np.stack([d, k, p - j], 1)[own], axis=0))
                for d, k, start in np.unique(np.concatenate(diagonals), axis=0).tolist():
                    lines[d, k].append(start)
                for (d, k), on in lines.items():
                    item = ix.words[k]
                    there = np.zeros(len(item), bool)
                    for start in on:
                        lo, hi = max(0, cut[d] - start), min(len(item), cut[d + 1] - start)
                        if hi <= lo:
                            continue
                        there[lo:hi] |= counted(h[start + lo : start + hi] == item[lo:hi], len(item))
                    n = int(there.sum())
                    if n >= min(min_words, int(np.ceil(share * len(item)))):
                        ids, best = found[a + d]
                        found[a + d] = (sorted({*ids, ix.ids[k]}, key=lambda i: (i is None, i or 0)), max(best, n / len(item)))
            yield pd.DataFrame({"id": pdf["id"], "items": pd.Series([x[0] for x in found], dtype=object), "matched": [x[1] for x in found]})

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, share: float = 0.8, min_item: int = 5) -> DataFrame:
    """One row per document: ``id_col, contaminated, n_items, items`` (ids, sorted) and ``matched`` (largest share of an item's words)."""
    spark = docs.sparkSession
    bench = durable(benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").alias("text")).where("text is not null"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if blocks > 1:
        text = durable(text.withColumn("row", F.monotonically_increasing_id()))
    parts = []
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        index = spark.sparkContext.broadcast(Index([(r.item, r.text) for r in rows], min_item))
        of = text if blocks == 1 else text.select(F.col("row").alias("id"), "text")
        parts.append(of.mapInPandas(scan(index, min_words, share), "id long, items array<long>, matched double"))
    out = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            out = out.union(p)
        out = out.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("matched").alias("matched"))
        out = out.withColumnRenamed("id", "row").join(text.select("row", "id"), "row").drop("row")
    return out.select(F.col("id").alias(id_col), (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), "items", F.col("matched"))
