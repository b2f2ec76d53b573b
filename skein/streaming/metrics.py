"""A log of invocations that batches are appended to once each, whatever is replayed, and what of it has been synced.

A batch is a folder named by its id, written whole or not at all and replaced when it comes again; so is what a sync marks.  A streaming
query that writes here delivers each invocation exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROW = "id string, session string, tool_name string, ts timestamp, raw_tokens long, optimized_tokens long, tokens_saved long, duration_ms double"


class MetricsLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, batch: str | int) -> None:
        """Store a batch; the same batch again changes nothing."""
        names = [c.split()[0] for c in ROW.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def sink(self, stream: DataFrame, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
        """Append a stream of rows; with ``every=None`` what is there, once."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return stream.writeStream.foreachBatch(lambda df, n: self.append(df, f"s{n}")).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def _read(self, part: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(f"{schema}, batch string").parquet(str(at)).drop("batch") if there else self.spark.createDataFrame([], schema)

    def invocations(self) -> DataFrame:
        """All rows, each id once, with ``synced`` and ``synced_at``."""
        done = self._read("synced", "id string, synced_at timestamp").groupBy("id").agg(F.min("synced_at").alias("synced_at"))
        return self._read("log", ROW).dropDuplicates(["id"]).join(done, "id", "left").withColumn("synced", F.col("synced_at").isNotNull())

    def unsynced(self, limit: int = 100) -> DataFrame:
        """The oldest rows that no sync has marked."""
        return self.invocations().where("not synced").orderBy("ts", "id").limit(limit)

    def mark_synced(self, ids: DataFrame, batch: str | int) -> None:
        """Mark ``ids(id)``; a mark that is repeated changes nothing."""
        ids.select("id").distinct().withColumn("synced_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.path}/synced/batch={batch}")

    def status(self) -> DataFrame:
        """One row: ``total, synced, pending, last_synced``."""
        synced = F.coalesce(F.sum(F.col("synced").cast("long")), F.lit(0))
        return self.invocations().agg(F.count("*").alias("total"), synced.alias("synced"), (F.count("*") - synced).alias("pending"), F.max("synced_at").alias("last_synced"))

    def session_totals(self, session: str) -> DataFrame:
        """Calls and tokens of a session by tool."""
        own = self.invocations().where(F.col("session") == session)
        return own.groupBy("tool_name").agg(F.count("*").alias("calls"), F.sum("tokens_saved").alias("tokens_saved"), F.round(F.avg("duration_ms"), 1).alias("mean_ms")).orderBy("tool_name")

    def reset(self) -> None:
        """Forget everything."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
