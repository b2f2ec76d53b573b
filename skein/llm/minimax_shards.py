"""Sharding by minimax contiguous partition: the smallest shard capacity that whole groups allow.

Groups are documents with equal texts, ordered by size class (large ones first, so that small groups
fill the ends) and then by a hash of the text; a shard is a run of groups.  A binary search finds the smallest capacity at which greedy filling needs no more than the
wanted number of shards, and the greedy cuts at that capacity are made.

The driver never holds all groups.  It starts from sums over at most 65536 ranges of that order and keeps, for
each range, size and largest group.  Greedy filling over ranges gives a capacity that is surely
enough (a range is taken or left whole) and one that is surely too small (a range is cut anywhere);
only ranges in which a cut may lie are split further, until these hold single groups and the
answer is exact.

Defined edge cases: a null text has size ``8`` and forms one group, apart from empty texts; repeated
rows count each; an empty table gives an empty result; fewer groups than shards leave shards empty;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

#: Slots are counted in so many salted parts of each shard.
SALTS = 128
#: A capacity over so many times the mean is taken as forced by one group.
EVEN = 1.01


def _greedy(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive) of the runs that greedy filling makes, or None if they are more than ``shards``."""
    ends, sums, at = [], np.cumsum(sizes), 0
    while at < len(sizes):
        if len(ends) == shards:
            return None
        base = sums[at - 1] if at else 0
        nxt = int(np.searchsorted(sums, base + capacity, side="right"))
        if nxt == at:
            return None
        ends.append(nxt)
        at = nxt
    return ends


def minimax_capacity(sizes: np.ndarray, shards: int) -> int:
    """Smallest capacity for which greedy runs over ``sizes`` number at most ``shards``."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return 0
    lo, hi = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        if _greedy(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _ranges(groups: DataFrame, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Rows (first hash, last hash, size, largest group, groups) of ``2**bits`` parts of each given hash range (unsigned order)."""
    spark = groups.sparkSession
    if low is None:
        part, of = groups.withColumn("cell", F.shiftrightunsigned("h", 64 - bits)), ["cell"]
    else:
        want = spark.createDataFrame([(int(a), int(b)) for a, b in zip(low, high, strict=True)], "a long, b long")
        spans = F.broadcast(want)  # at most a few hundred rows for each shard
        part = groups.join(spans, (F.col("u") >= F.col("a")) & (F.col("u") <= F.col("b")))
        part, of = part.withColumn("cell", F.floor((F.col("u") - F.col("a")) / F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a") + 1) / (1 << bits))))), ["a", "cell"]
    rows = part.groupBy(*of).agg(F.min("u").alias("a0"), F.max("u").alias("b0"), F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count("*").alias("n")).select("a0", "b0", "s", "m", "n").toPandas()
    return rows.sort_values("a0").to_numpy(np.int64)


def plan_cuts(groups: DataFrame, shards: int, first_bits: int = 16, more_bits: int = 6) -> list[int]:
    """Last hash (shifted to signed order) of each shard, from ``groups(h, u, bytes)``."""
    cells, cuts = _ranges(groups, None, None, first_bits), []
    while shards and len(cells):
        cells, capacity = _settle(groups, cells, shards, more_bits)
        ends = _greedy(cells[:, 2], capacity, shards)
        if capacity > EVEN * -(-int(cells[:, 2].sum()) // shards):
            ends = ends[:1]  # one large group forces this capacity: the other shards get their own smallest one
        cuts += [int(cells[e - 1, 1]) for e in ends]
        cells, shards = cells[ends[-1] :], shards - len(ends)
    return cuts


def _settle(groups: DataFrame, cells: np.ndarray, shards: int, more_bits: int) -> tuple[np.ndarray, int]:
    """Split ranges until the smallest capacity for ``shards`` runs is exact; the ranges and that capacity."""
    while True:
        total, biggest = int(cells[:, 2].sum()), int(cells[:, 3].max())
        low = max(biggest, -(-total // shards))
        sums = np.concatenate(([0], np.cumsum(cells[:, 2])))

        split = (cells[:, 2] > low) & (cells[:, 4] > 1)  # at most ``shards`` ranges that no shard could take whole
        if not split.any():
            high = minimax_capacity(cells[:, 2], shards)
            if high == low:
                break
            # the k-th cut lies between greedy filling of whole ranges at the smallest capacity and free cuts at the largest
            open_, early, late = np.zeros(len(cells), bool), 0, 0
            for _ in range(shards):
                early = int(sums[np.searchsorted(sums, early + low, side="right") - 1])
                late = min(late + high, total)
                a, b = np.searchsorted(sums, early, side="right") - 1, np.searchsorted(sums, late, side="right") - 1
                open_[max(0, a) : b + 1] = True
            split = open_ & (cells[:, 4] > 1)
        if not split.any():
            break
        fine = _ranges(groups, cells[split, 0], cells[split, 1], more_bits)
        cells = np.concatenate([cells[~split], fine])
        cells = cells[np.argsort(cells[:, 0], kind="stable")]
    return cells, minimax_capacity(cells[:, 2], shards)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.col(text_col)
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    d = docs.select(
        F.col(id_col).alias("id"),
        (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("crc"),
        F.xxhash64(text, text.isNull()).alias("text_hash"),
    )
    d = durable(d)
    of_text = d.groupBy("text_hash").agg(F.sum("size").alias("bytes"))
    # six bits of size class, large first, then 58 bits of the hash; u has the signed order of h's unsigned one
    size_class = F.least(F.lit(62), F.length(F.bin("bytes"))).cast("long")
    h = F.shiftleft(F.lit(63) - size_class, 58).bitwiseOR(F.shiftrightunsigned("text_hash", 6))
    of_text = durable(of_text.withColumn("h", h).withColumn("u", F.col("h").bitwiseXOR(F.lit(-(2**63)))))
    groups = durable(of_text.groupBy("h", "u").agg(F.sum("bytes").alias("bytes")))
    d = durable(d.join(of_text.select("text_hash", "u"), "text_hash"))
    cuts = plan_cuts(groups, shards)
    at = F.lit(0)
    for c in cuts[:-1]:
        at = at + (F.col("u") > F.lit(c)).cast("int")
    d = d.withColumn("shard", at.cast("int")).withColumn("salt", F.pmod(F.xxhash64("id", "u"), F.lit(SALTS)).cast("int"))
    per = d.groupBy("shard", "salt").agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("shard", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "salt").orderBy("u", "id")
    d = d.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(per), ["shard", "salt"])  # at most shards x SALTS rows
    return d.select(
        F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("nth") + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
