"""MinHash near-duplicates with odd sketches: the documents whose word shingles overlap.

``near_duplicates`` lower-cases A-Z, takes words ``[^\\x20\\x09-\\x0D]+`` and the set of distinct
5-word shingles (all words as one shingle if there are fewer).  Documents link where
``100 * intersection >= 75 * union``.  Candidates share one of 48 bands of 5 MinHash values (a pair
at the threshold is missed with probability 3e-6); parity sketches of the 240 values screen them and
the full shingle sets confirm them.

Defined edge cases: null or blank texts have no shingles, link with nothing and are their own
component; equal sets (copies) always share a component; repeated rows stay repeated; a null id stays
null, with ``component_id`` of its class; columns beyond id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MinHash, Screen, components, durable, linked_components, semi_by_size, shared_buckets, shingles, word_hashes

__all__ = ["near_duplicates", "components"]

SIGN = "id long, n int, node long, bands array<long>, sketch array<long>"


def signer(bands: int, rows: int, k: int):
    """Batches of (id, text) to signatures; a set already signed by the same task carries no bands again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mh, seen = MinHash(bands, rows), set()
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                sets = [shingles(w, k) for w in word_hashes(part["text"].tolist())]
                node = [set_id(s) for s in sets]
                fresh = []
                for i, x in enumerate(node):
                    if len(sets[i]) and x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if len(seen) > 1_000_000:
                    seen.clear()
                keys, sketch = [None] * len(sets), [None] * len(sets)
                if fresh:
                    low = mh.minima([sets[i] for i in fresh])
                    for i, a, b in zip(fresh, mh.keys(low), mh.sketch(low), strict=True):
                        keys[i], sketch[i] = a, b
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": [len(s) for s in sets], "node": node, "bands": pd.Series(keys, dtype=object), "sketch": pd.Series(sketch, dtype=object)})

    return run


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a sorted set of hashes."""
    x = int((s * (s >> np.uint64(17) | np.uint64(1))).sum()) ^ (int(s.sum()) * 0x9E3779B97F4A7C15) + len(s)
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def gram_rows(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                sets = [shingles(w, k) for w in word_hashes(part["text"].tolist())]
                yield pd.DataFrame({"node": [set_id(s) for s in sets], "grams": [s.view(np.int64) for s in sets]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, bands: int = 48, rows: int = 5) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``."""
    mh = MinHash(bands, rows)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = durable(text.mapInPandas(signer(bands, rows, k), SIGN))
    at = F.coalesce("id", F.lit(-(2**63))).alias("at")  # rows without an id are found too

    def sketches_of(nodes: DataFrame) -> DataFrame:
        return semi_by_size(sig.where("bands is not null").select("node", "n", "sketch"), nodes, "node").dropDuplicates(["node"])

    def grams_of(nodes: DataFrame) -> DataFrame:
        first = durable(sig.where("bands is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(at).alias("at")).select("at").distinct())
        own = semi_by_size(text.select(at, "text"), first, "at").select("text").mapInPandas(gram_rows(k), "node long, grams array<long>")
        return own.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    comp = linked_components(shared_buckets(sig), sketches_of, grams_of, num, den, Screen(num, den, mh.most_ones(num / den), mh.bits))
    # a document's class is its component of sets or its own set; sets of no words stand alone
    doc = sig.select("id", F.col("n").alias("n_shingles"), "node").join(comp, "node", "left")
    doc = durable(doc.select("id", "n_shingles", F.coalesce("component", "node").alias("cls")))
    low = doc.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("low"))
    some = doc.where("n_shingles > 0").join(low, "cls").select("id", "n_shingles", F.col("low").alias("component_id"))
    none = doc.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = some.union(none)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_shingles").cast("long").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
