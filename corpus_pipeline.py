"""A training-corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

``STAGES`` holds (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next one's ``docs``.  Every stage works on all rows that the one
before it kept, and all but the last return the columns of ``documents``.

Edge cases: a stage that finds no rows returns none; null ids are kept by filters unless the stage's own
operator rejects the row; every row is decided by itself, since a stage first gives its rows a key
of their own that its operator carries, so null and repeated ids neither drop nor keep other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import minimax_shards, odd_minhash, source_mix, spaced_seeds, toxicity
from skein.llm.common import durable, join_by_size, only, table

ROW = "_row"

SHARDS = 24


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row in ``ROW``, written once so that every later read sees the same keys."""
    return durable(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _without(rows: DataFrame, rejected: Callable[[], DataFrame]) -> DataFrame:
    """Rows of ``rows`` whose key is not among those of ``rejected()``; the list is broadcast only if its counted size is small.

    Once the list is written, what the operator wrote on its way goes.
    """
    return join_by_size(rows, only(lambda: rejected().select(ROW)), ROW, "left_anti").drop(ROW)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    rows = _keyed(docs)
    return _without(rows, lambda: toxicity.toxicity(rows, table(spark, sf_dir, "labels"), row_col=ROW).where("predicted = 1")).select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    rows = _keyed(docs)
    return _without(rows, lambda: odd_minhash.near_duplicates(rows, id_col=ROW).where("not kept")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    rows = _keyed(docs)
    return _without(rows, lambda: spaced_seeds.contamination(rows, table(spark, sf_dir, "benchmark"), id_col=ROW).where("contaminated")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = _keyed(docs)
    copies = only(lambda: source_mix.mix(rows, row_col=ROW).select(ROW, "copies").where("copies > 0"))
    taken = join_by_size(rows, copies, ROW, row_bytes=24)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch")).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix in shards of near equal bytes."""
    return minimax_shards.shard(docs, SHARDS)


STAGES = [("toxicity", clean), ("near_duplicates", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The learnt and banded stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
