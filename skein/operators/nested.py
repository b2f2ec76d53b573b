"""Nested answers as VARIANT: what they mention and what they must not hold, by rounds that open one level each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traverse import settle

#: Fields under which an answer names symbols and files, and those that no payload may hold: fixed values.
IDS, PATHS = ("id", "node_id", "src", "dst", "target", "symbol_id"), ("path", "file", "file_path")
FORBIDDEN = ("content", "source", "text", "context_line", "context_before", "context_after")
#: Levels of objects and arrays that collecting opens.
DEPTH = 5


class Leak(ValueError):
    """A payload that holds source text."""


def _opened(level: DataFrame) -> DataFrame:
    """Members of the objects and arrays of ``level(key, v)``: ``(key, field, v)``; ``field`` is null in arrays, plain values have none."""
    inside = level.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("field"), F.col("value").alias("w"))
    return level.select("key", "v").lateralJoin(inside).select("key", "field", F.col("w").alias("v"))


def _parsed(df: DataFrame, key: str, json: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.try_parse_json(json).alias("v")).where("v is not null")


def fields(df: DataFrame, key: str, json: str, depth: int = DEPTH) -> DataFrame:
    """``(key, depth, field, text)`` of the fields of objects up to ``depth`` levels deep; text that is no JSON has none."""
    level, out = _parsed(df, key, json), []
    for k in range(1, depth + 1):
        level = _opened(level)
        out.append(level.where("field is not null").select(F.col("key").alias(key), F.lit(k).alias("depth"), "field", F.try_variant_get("v", "$", "string").alias("text")))
    return reduce(DataFrame.union, out)


def touched(answers: DataFrame, key: str = "answer", json: str = "body") -> DataFrame:
    """``(answer, id, path)``: the symbols and files that answers mention, for ``metrics.impact``."""
    f = fields(answers, key, json).where("text is not null")
    one = lambda names, as_: F.when(F.col("field").isin(*names), F.col("text")).alias(as_)
    return f.select(F.col(key).alias("answer"), one(IDS, "id"), one(PATHS, "path")).where("id is not null or path is not null").distinct()


def guard(payload: DataFrame, json: str = "row") -> DataFrame:
    """``payload`` itself, if no object at any depth of its JSON has a forbidden field."""
    level = _parsed(payload.withColumn("_n", F.lit(0)), "_n", json)
    while True:
        level = settle(_opened(level))
        bad = level.where(F.lower("field").isin(*FORBIDDEN)).select("field").first()
        if bad:
            raise Leak(f"a field {bad.field!r} may hold source text")
        if level.isEmpty():
            return payload
