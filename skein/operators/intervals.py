"""Points in intervals by equality: spans are cut into dyadic blocks, and a point lies in one block of every size.

A span of ``n`` places is at most ``2 log2(n)`` blocks, and a point asks for one block of each size that the spans have (``LEVELS`` at most), so what is joined grows
with the points and the spans and not with their product, however many of both one file has.  A pair of a point and a span meets in
exactly one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of blocks, 1 to 2 ** (LEVELS - 1) places: lines or bytes of a file that is read.
LEVELS = 22
_BLOCK = "struct<level:int,block:long>"


def blocks(low: Column, high: Column) -> Column:
    """The largest dyadic blocks that together are the places ``low`` to ``high``, both included."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        a, b = F.ceil(low / size), F.floor((high + 1) / size)
        left = F.when((a < b) & (a % 2 == 1), F.struct(level.cast("int").alias("level"), a.cast("long").alias("block")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(level.cast("int").alias("level"), (b - 1).cast("long").alias("block")))
        return F.array(left, right)

    # places from the last level on, which are rare, are held by blocks of that level
    top = LEVELS - 1
    size = 1 << top
    # a block is no longer than its span; one level more for the rounding of the logarithm
    high_level = F.least(F.lit(top - 1), F.floor(F.log2((high - low + 1).cast("double"))).cast("int") + 1)
    whole = F.when(F.ceil(low / size) < F.floor((high + 1) / size), F.transform(F.sequence(F.ceil(low / size), F.floor((high + 1) / size) - 1), lambda i: F.struct(F.lit(top).alias("level"), i.cast("long").alias("block")))).otherwise(F.array().cast(f"array<{_BLOCK}>"))
    return F.array_compact(F.concat(F.flatten(F.transform(F.sequence(F.lit(0), high_level), at)), whole))


def around(place: Column, levels: list[int]) -> Column:
    """The block of each of some sizes that holds a place."""
    return F.transform(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: F.struct(k.cast("int").alias("level"), F.floor(place / F.pow(F.lit(2.0), k)).cast("long").alias("block")))


def stab(points: DataFrame, spans: DataFrame, by: list[str], place: str, low: str, high: str) -> DataFrame:
    """Every pair of a row of ``points`` and one of ``spans`` with ``low <= place <= high`` and equal ``by``; no other column may be in both."""
    s = spans.where((F.col(low) >= 0) & (F.col(low) <= F.col(high))).withColumn("_b", F.explode(blocks(F.col(low), F.col(high))))
    # points ask for the sizes that some span has: at most ``LEVELS`` numbers reach the driver
    used = sorted(s.agg(F.collect_set("_b.level")).first()[0])
    p = points.where(F.col(place) >= 0).withColumn("_b", F.explode(around(F.col(place), used)))
    return p.join(s, [*by, "_b"]).drop("_b")
