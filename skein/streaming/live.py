"""Streams: a graph that follows its tree, and windowed counts of invocations."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import LineageGraph, current
from ..sources import code

#: Seconds without a change before a change counts.
QUIET = 1.5


class Follower:
    """Keeps the graph at ``out`` like the tree at ``root``; asked again and again, it acts when the tree has been quiet for a while.

    What the tree looked like is compared by path, time and size of its files, so deletions count as well; what is done is an update of the
    stored graph, which compares contents, so nothing is lost when a follower ends and another begins.
    """

    def __init__(self, spark: SparkSession, root: str, out: str, quiet: float = QUIET, then: Callable[[LineageGraph], None] | None = None):
        self.spark, self.root, self.out, self.quiet, self.then = spark, root, out, quiet, then
        self.seen = self.done = None
        self.since = 0.0

    def look(self) -> tuple:
        """The state of the tree, folded to a few numbers; no content is read."""
        rows = code.listing(self.spark, self.root).select(F.xxhash64("path", "modificationTime", "length").alias("h"))
        return tuple(rows.agg(F.count("*"), F.sum(F.pmod("h", F.lit(1 << 40))), F.bit_xor("h")).first())

    def step(self, now: float) -> LineageGraph | None:
        """Look once; the new graph if there is one."""
        state = self.look()
        if state != self.seen:
            self.seen, self.since = state, now
        if state == self.done or now - self.since < self.quiet:
            return None
        self.done = state
        try:
            return self.catch_up()
        except Exception:  # a tree that cannot be read now is looked at again when it changes
            logging.getLogger(__name__).exception("update of %s failed", self.root)
            return None

    def catch_up(self) -> LineageGraph | None:
        """Build or update; None if the stored graph is like the tree."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.out)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) and current(self.spark, self.out) != self.out
        old = LineageGraph(self.spark, self.out) if there else None
        new = old.update(self.root) if old else LineageGraph.build(self.spark, self.root, self.out)
        if new is old:
            return None
        if self.then:
            self.then(new)
        return new


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, every: str | None = "1 second", then: Callable[[LineageGraph], None] | None = None, quiet: float = QUIET) -> StreamingQuery:
    """A streaming query that keeps ``out`` like ``root``: a look at each trigger, an update after ``quiet`` seconds without a change.

    With ``every=None`` it looks once, waits for nothing and ends.
    """
    follower = Follower(spark, root, out, quiet, then)
    if every is None:
        beat = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
        return beat.writeStream.foreachBatch(lambda _, n: follower.catch_up() if n >= 0 else None).option("checkpointLocation", checkpoint).trigger(once=True).start()
    beat = spark.readStream.format("rate").option("numPartitions", 1).load()
    return beat.writeStream.foreachBatch(lambda _, n: follower.step(time.time())).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def windowed(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and keys of a stream or table; rows later than the watermark are not counted in a stream."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
