"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources in code-point order (null last) take weights from a repeating list and share all words of the
corpus; a source's target stops at ``max_epochs`` times its own size and the excess is dealt again by
weight (a water level).  Whole epochs of a source come first; the fractional epoch takes documents in
the order of ``-ln(u) / q``, where ``u`` is a hash of seed and id and ``q`` a quality weight of the
text, up to the remaining budget of words.

The prefix sum never runs over a whole source: keys are dealt into ``BUCKETS`` ranges, the sums of
ranges are added up first, and rows are added up inside their range.

Defined edge cases: null or empty texts have size 0 and are never taken; a null id hashes as such;
repeated rows count each; with no words at all every target is 0; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    n = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    return F.when(text.isNull(), F.lit(0)).otherwise(n).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1: the share of the text's characters left without digits and ASCII symbols."""
    bare = F.length(F.translate(text, "0123456789!#$%&*+<=>@[]\\^_`{|}~", ""))
    return F.coalesce(0.25 + 0.75 * bare / F.greatest(F.length(text), F.lit(1)), F.lit(0.25))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``.  Sorting by the level at which a source is full gives the water level in one pass."""
    nth = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(nth) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("full_at", F.col("cap") / F.col("weight"))
    every, before = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / open_)
    # the first source that the level does not fill sets the level of all after it
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(every)
    s = s.withColumn("water", level["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_epochs: int = 3,
    seed: int = 7,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, taken, copies``, and ``row_col`` as it came if named."""
    text = F.col(text_col)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), (-F.log(u) / quality_weight(text)).alias("key"), *([F.col(row_col).alias("row")] if row_col else []))
    d = durable(d.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")))
    cells = d.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    goal = source_targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell").over(run), F.lit(0)))
    cells = cells.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "cell")
    cells = durable(cells).withColumnsRenamed({"source": "s", "bucket": "b"})
    w = W.partitionBy("source", "bucket").orderBy("key", "id", "size", *(["row"] if row_col else [])).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    d = d.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # a document is in the fractional epoch if more than half of it lies within the remaining budget
    more = (F.col("size") > 0) & (F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("rest"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + more.cast("long")).otherwise(F.lit(0)).cast("long")
    return d.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *([F.col("row").alias(row_col)] if row_col else []))
