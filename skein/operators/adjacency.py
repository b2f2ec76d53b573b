"""Edges at rest in walking order: written once by their source and once by their destination, so that a walk reads what its frontier touches.

A row's bin is ``crc32(end) % bins``, the same number in Spark and in Python, and bins are folders: a frontier of few nodes
reads the few folders that hold their edges, and a one-hop question one of them.  Inside a bin rows are sorted by that end, with a Parquet
Bloom filter on it, so that row groups without the wanted nodes are left out too.  Nodes with very many edges fill several
files of their bin (the rebalancing planner splits them).  ``Lookup`` stores rows under a key in the same way.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a bin is meant to hold, and the least and most bins.
BIN_ROWS, LEAST_BINS, MOST_BINS = 200_000, 32, 4096
#: Keys of a question that are pushed down to the files themselves; more prune bins only.
PUSHED = 64


def bin_of(key: Column, bins: int) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(bins)).cast("int")


def bins_for(rows: int) -> int:
    return max(LEAST_BINS, min(MOST_BINS, -(-rows // BIN_ROWS)))


def write_by(df: DataFrame, key: str, path: str, bins: int) -> None:
    """``df`` in folders ``bin=..`` by ``key``, sorted by it, with a Bloom filter on it; null keys are kept in bin 0."""
    out = df.withColumn("bin", F.coalesce(bin_of(F.col(key), bins), F.lit(0)))
    out = out.hint("rebalance", "bin").sortWithinPartitions("bin", key)
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(BIN_ROWS)}
    out.write.mode("overwrite").options(**bloom).partitionBy("bin").parquet(path)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not any(x.isDirectory() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)):
        df.limit(0).write.parquet(f"{path}/bin=0")  # without rows there is no folder, and so no schema


@dataclass
class Lookup:
    """A table written by ``write_by``: rows of some keys without reading the others."""

    table: DataFrame
    key: str
    bins: int

    @classmethod
    def write(cls, df: DataFrame, key: str, path: str, bins: int) -> Lookup:
        write_by(df, key, path, bins)
        return cls.open(df.sparkSession, path, key, bins)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str, bins: int) -> Lookup:
        return cls(spark.read.parquet(path), key, bins)

    def all(self) -> DataFrame:
        return self.table.drop("bin")

    def of(self, *keys: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """The rows of a few named keys; ``kinds`` are those that the caller keeps of them."""
        if not keys:
            return self.all().limit(0)
        at = sorted({zlib.crc32(k.encode("utf-8", "surrogatepass")) % self.bins for k in keys})
        return self.table.where(F.col("bin").isin(at) & F.col(self.key).isin(list(keys))).drop("bin")

    def near(self, keys: DataFrame, touched: tuple[int, list[int]] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """The rows whose key may be among ``keys(key)``: those of the same bins, for a join that follows; ``kinds`` as for ``of``."""
        n, at = touched or self.touched(keys)
        if n <= PUSHED:
            return self.of(*{r[0] for r in keys.collect() if r[0] is not None})
        return (self.table.where(F.col("bin").isin(at)) if len(at) < self.bins else self.table).drop("bin")

    def touched(self, keys: DataFrame) -> tuple[int, list[int]]:
        """Rows of ``keys`` and the bins that they touch; at most one number for each bin reaches the driver."""
        r = keys.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(bin_of(keys[keys.columns[0]], self.bins))).alias("bins")).first()
        return r.n, r.bins


@dataclass
class Adjacency:
    """Edges stored by ``src`` (``forward``) and by ``dst`` (``backward``)."""

    forward: Lookup
    backward: Lookup

    @classmethod
    def write(cls, edges: DataFrame, path: str, bins: int | None = None) -> Adjacency:
        """Store ``edges`` under ``path``; ``edges`` is read twice, so it should be at rest itself."""
        bins = bins or bins_for(edges.count())
        for key, at in (("src", "edges"), ("dst", "edges_by_dst")):
            write_by(edges, key, f"{path}/{at}", bins)
        return cls.open(edges.sparkSession, path, bins)

    @classmethod
    def open(cls, spark: SparkSession, path: str, bins: int) -> Adjacency:
        return cls(Lookup.open(spark, f"{path}/edges", "src", bins), Lookup.open(spark, f"{path}/edges_by_dst", "dst", bins))

    @property
    def edges(self) -> DataFrame:
        return self.forward.all()

    def side(self, direction: str) -> Lookup:
        if direction not in ("forward", "backward"):
            raise ValueError(f"direction must be forward or backward, not {direction!r}")
        return self.forward if direction == "forward" else self.backward

