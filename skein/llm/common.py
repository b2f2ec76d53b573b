"""Shared pieces of the training-data operators: tables, durable stages, text hashing, components, banded links.

Text hashing is vectorised numpy over UTF-8 bytes.  A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]`` after ASCII lower-casing; every hash is 64 bits wide.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK = 1 << 19  # bytes of text that are hashed at once
#: Largest table, in bytes, that is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


#: Rows of an Arrow batch; texts may be long, and a batch is held in memory by the JVM and by Python.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches from their default to ``BATCH_ROWS``; a value that was chosen stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- durable stages


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or else the one given to ``setCheckpointDir``; a temporary one only in local mode."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def _forget(jvm_fs, path) -> None:
    try:
        jvm_fs.delete(path, True)
    except Exception:  # the session may be gone at exit
        pass


#: Files of durable stages that are still there, by the table read from them.
_files: dict[int, tuple] = {}


def free(*tables: DataFrame) -> None:
    """Delete the files of durable stages that no later plan reads; other tables are left alone."""
    for t in tables:
        if at := _files.pop(id(t), None):
            atexit.unregister(at[0])
            _forget(*at[1:3])


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, sizes are known, columns prune.

    Every executor and the driver see the files, so a lost executor costs no recomputation.  The
    files go with ``free``, or when the driver ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/skein/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    last = partial(_forget, fs, jpath)
    atexit.register(last)
    out = spark.read.schema(df.schema).parquet(path)
    _files[id(out)] = (last, fs, jpath, out)
    return out


def only(make: Callable[[], DataFrame]) -> DataFrame:
    """The durable result of ``make()``; durable tables that it wrote on the way, which nothing else reads, are deleted."""
    before = set(_files)
    out = durable(make())
    free(*[f[3] for k, f in list(_files.items()) if k not in before and f[3] is not out])
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def join_by_size(df: DataFrame, other: DataFrame, key: str | list[str], how: str = "inner", row_bytes: int = 16) -> DataFrame:
    """``df`` joined with ``other`` (durable) on ``key``; ``other`` is broadcast only if its counted rows are small."""
    small = other.count() * row_bytes <= BROADCAST_BYTES
    return df.join(F.broadcast(other) if small else other.hint("merge"), key, how)


def semi_by_size(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return join_by_size(df, keys, key, "left_semi")


# --------------------------------------------------------------------------- hashing of words

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
WORD_COEF = _rng.integers(0, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    y = x >> U64(32)
    y ^= x
    y *= U64(0xD6E8FEB86659FD93)
    x = y >> U64(29)
    y ^= x
    y *= U64(0xA0761D6478BD642F)
    x = y >> U64(32)
    y ^= x
    return y


def ascii_lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def word_chunks(texts: list[str | None], prepare: Callable[[str], bytes] = ascii_lower) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of words, some texts at a time: ``(i, h, cut)``; words of text ``i + k`` are ``h[cut[k]:cut[k + 1]]``."""
    i = 0
    while i < len(texts):
        parts, size = [], 0
        while i + len(parts) < len(texts) and (not parts or size < CHUNK):
            t = texts[i + len(parts)]
            parts.append(b"" if t is None else prepare(t))
            size += len(parts[-1]) + 1
        buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        up, down = power_tables(len(buf) + 1)
        ws = _WS[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], ws)).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start])
        yield i, h, np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))
        i += len(parts)


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, in order, the 64-bit hashes of its words."""
    for _, h, cut in word_chunks(texts):
        for k in range(len(cut) - 1):
            yield h[cut[k] : cut[k + 1]]


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * WORD_COEF[:n]).sum(keepdims=True) + WORD_COEF[32 + n])
    s = words[: n - k + 1] * WORD_COEF[0]
    for j in range(1, k):
        s = s + words[j : n - k + 1 + j] * WORD_COEF[j]
    return np.unique(mix(s))


# --------------------------------------------------------------------------- MinHash

#: Elements of sets that are hashed at once.
HASHED = 1 << 16

class MinHash:
    """``bands * rows`` minima of sets of 64-bit hashes, their band keys, and an odd sketch of them.

    An odd sketch toggles one bit per MinHash sample; the XOR of two sketches has about
    ``bits/2 * (1 - exp(-4 k (1-J) / bits))`` ones, which is sharp at high similarities.
    """

    def __init__(self, bands: int, rows: int, bits: int = 1024):
        self.bands, self.rows, self.bits = bands, rows, bits
        g = np.random.Generator(np.random.PCG64(977))
        k = bands * rows
        self.mul = g.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = g.integers(0, 2**32, k, dtype=np.uint32)
        self.coef = g.integers(0, 2**63, (bands, rows), dtype=U64) * U64(2) + U64(1)
        self.salt = g.integers(0, 2**64, bands, dtype=U64)
        self.where = g.integers(0, 2**64, k, dtype=U64)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima for each non-empty set."""
        return self.minima_of(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))

    def minima_of(self, elements: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The same for sets that lie one after another: set ``i`` is ``elements[cut[i]:cut[i + 1]]``."""
        out = np.empty((len(self.mul), len(cut) - 1), np.uint32)
        i, x32 = 0, (elements >> U64(32)).astype(np.uint32)
        while i < len(cut) - 1:
            j = max(i + 1, int(np.searchsorted(cut, cut[i] + HASHED, side="right")) - 1)
            x, at = x32[cut[i] : cut[j]], cut[i:j] - cut[i]
            h = np.empty_like(x)
            for k in range(len(self.mul)):  # one hash function at a time, so that its values stay in the cache
                np.bitwise_xor(x, self.add[k], out=h)
                np.multiply(h, self.mul[k], out=h)
                np.minimum.reduceat(h, at, out=out[k, i:j])
            i = j
        return np.ascontiguousarray(out.T)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(len(minima), self.bands, self.rows).astype(U64)
        return mix((m * self.coef[None]).sum(2) + self.salt[None]).view(np.int64)

    def sketch(self, minima: np.ndarray) -> np.ndarray:
        """Parity bitmap of ``bits`` bits as int64 words."""
        pos = (mix(minima.astype(U64) * U64(0x9E3779B1) + self.where[None]) >> U64(20)) % U64(self.bits)
        flat = (pos + (np.arange(len(pos), dtype=U64) * U64(self.bits))[:, None]).ravel().astype(np.int64)
        odd = (np.bincount(flat, minlength=len(pos) * self.bits) & 1).astype(np.uint8)
        return np.packbits(odd.reshape(len(pos), self.bits), axis=1).view(np.int64)

    def most_ones(self, similarity: float, sigmas: float = 4.5) -> int:
        """XOR population count that a pair of that similarity exceeds only by a ``sigmas`` event."""
        k, n, j = len(self.mul), self.bits, similarity
        fall = np.exp(-4 * k * (1 - j) / n)
        mean, p = n / 2 * (1 - fall), (1 - fall) / 2
        # spread of the samples that differ, carried over to bits, and spread of the bits themselves
        sd = ((2 * fall) ** 2 * k * j * (1 - j) + n * p * (1 - p)) ** 0.5
        return int(min(n, np.ceil(mean + sigmas * sd)))


# --------------------------------------------------------------------------- components


#: Links that one task joins by itself; more are joined in rounds over all tasks.
FEW_LINKS = 1 << 16


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = Union()
    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            sets.join(u, v)
    nodes = list(sets.up)
    roots = [sets.find(x) for x in nodes]
    nodes, roots = nodes + sorted(set(roots)), roots + sorted(set(roots))
    yield pd.DataFrame({"node": nodes, "component": roots}, dtype="int64").drop_duplicates("node")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` (longs): rows ``(node, component)``, the smallest node of each.

    Alternating large-star and small-star steps on DataFrames.  Every grouping is a pre-aggregated
    minimum and every join one that the adaptive planner can split, so a hub with a third of all
    links does not land in one task.  Nothing is collected; each round is written and reread.  Up to
    ``FEW_LINKS`` counted links are joined in one task instead.
    """
    e = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = e.count()
    if n <= FEW_LINKS:
        out = durable(e.coalesce(1).mapInPandas(_forest, "node long, component long"))
        free(e)
        return out
    while n:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        # done when no node has two smaller neighbours and no root hangs below another
        n, roots, mixed = new.count(), new.select("u").distinct().count(), new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        free(e, large)
        e = new
        if n == roots and mixed:
            break
    out = durable(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", F.col("v").alias("w")).distinct()))
    free(e)
    return out


#: Members of a bucket that one tile compares with as many others, by sketch and by whole sets.
SKETCH_BLOCK, SET_BLOCK = 256, 128


class Union:
    """Union-find over the labels of one tile."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _ones(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.zeros((len(p), len(q)), np.int32)
    for j in range(p.shape[1]):
        out += np.bitwise_count(p[:, None, j] ^ q[None, :, j])
    return out


def _tiles(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers ordered by tile (key, one, two), and where each tile begins, with the end."""
    names = [pdf[c].to_numpy() for c in ("two", "one", "key")]
    order = np.lexsort(names)
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.any([x[order[1:]] != x[order[:-1]] for x in names], axis=0)
    return order, np.flatnonzero(new)


class Screen:
    """The largest XOR population count of the odd sketches of two sets that link, by their sizes.

    Either a constant (sketches of a fixed number of MinHash samples), or, for parity bitmaps of whole sets, what
    the ``(na + nb) * (den - num) / (den + num)`` elements that two linked sets may hold apart toggle, and ``sigmas``.
    """

    def __init__(self, num: int, den: int, most: int | None = None, bits: int = 512, sigmas: float = 4.5):
        self.apart, self.most, self.bits, self.sigmas = (den - num) / (den + num), most, bits, sigmas

    def __call__(self, na, nb, exp=np.exp, sqrt=np.sqrt):
        if self.most is not None:
            return self.most
        p = (1 - exp(-2 * self.apart * (na + nb) / self.bits)) / 2
        return self.bits * p + self.sigmas * sqrt(self.bits * p * (1 - p)) + 1

    def columns(self, a: str, b: str):
        return F.lit(self.most) if self.most is not None else self(F.col(a), F.col(b), F.exp, F.sqrt)


#: Tiles of so few members are compared many at a time.
_SMALL = 32


_CLOSE = "key long, a long, b long"


def sketch_tile(screen: Screen):
    """Tiles of (key, one, two, block, node, c, n, sketch) to their members that are close to one of another component.

    Rows (key, node, c) of such members, and rows (null, c, d) with a forest of their components.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two, block, c, n = (pdf[x].to_numpy() for x in ("one", "two", "block", "c", "n"))
        s = np.stack(pdf["sketch"].to_numpy()).view(U64)
        order, cut = _tiles(pdf)
        size, found, near = np.diff(cut), [], np.zeros(len(c), bool)
        tile = np.empty(len(c), np.int64)
        tile[order] = np.repeat(np.arange(len(size)), size)
        names, own = np.unique(np.stack((tile, c), 1), axis=0, return_inverse=True)  # components of each tile, numbered in order
        own = own.reshape(-1)

        def close(p: np.ndarray, q: np.ndarray) -> None:
            ok = c[p] != c[q]
            p, q = p[ok], q[ok]
            ok = np.bitwise_count(s[p] ^ s[q]).sum(1, dtype=np.int32) <= screen(n[p], n[q])
            p, q = p[ok], q[ok]
            near[p] = near[q] = True
            found.append(np.unique(np.minimum(own[p], own[q]) * len(names) + np.maximum(own[p], own[q])))

        small = (size > 1) & (size <= _SMALL) & (one[order[cut[:-1]]] == two[order[cut[:-1]]])
        for m in np.unique(size[small]):
            rows = order[cut[:-1][small & (size == m)][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            step = max(1, (1 << 16) // len(i))
            for a in range(0, len(rows), step):
                close(rows[a : a + step][:, i].ravel(), rows[a : a + step][:, j].ravel())
        for t in np.flatnonzero((size > 1) & ~small):
            at = order[cut[t] : cut[t + 1]]
            x, y = at[block[at] == one[at[0]]], at[block[at] == two[at[0]]]
            for a in range(0, len(x), 64):
                close(np.repeat(x[a : a + 64], len(y)), np.tile(y, len(x[a : a + 64])))
        sets, edges = Union(), []
        for x in np.unique(np.concatenate(found)).tolist() if found else ():
            x, y = divmod(x, len(names))
            if sets.find(x) != sets.find(y):
                sets.join(x, y)
                edges.append((names[x, 1], names[y, 1]))
        links = pd.DataFrame(edges, columns=["a", "b"], dtype="int64").drop_duplicates()
        members = pdf.loc[near, ["key", "node", "c"]].set_axis(["key", "a", "b"], axis=1).drop_duplicates()
        return pd.concat([members.astype({"key": "Int64"}), links.assign(key=pd.array([pd.NA] * len(links), "Int64"))])[["key", "a", "b"]]

    return run


def as_sets(grams: list[np.ndarray]) -> list[np.ndarray]:
    return [np.sort(g) for g in grams]


def shared_size(g: np.ndarray, h: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(g) > len(h):
        g, h = h, g
    k = np.searchsorted(h, g)
    return int((h[np.minimum(k, len(h) - 1)] == g).sum())


def pair_check(num: int, den: int, sets: Callable[[list], list[np.ndarray]]):
    """Batches of (a, b, ga, gb) to the pairs (a, b) that link on their whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                x, y = sets(part["ga"].tolist()), sets(part["gb"].tolist())
                both = np.array([shared_size(g, h) for g, h in zip(x, y, strict=True)], np.int64)
                total = np.array([len(g) + len(h) for g, h in zip(x, y, strict=True)], np.int64)
                yield part.loc[both * den >= (total - both) * num, ["a", "b"]]

    return run


def set_tile(screen: Screen, num: int, den: int, make: Callable[[list], list[np.ndarray]]):
    """Tiles of (key, one, two, side, node, c, sketch, grams) to a forest of links confirmed on whole sets.

    Members that ask (``side`` 1) are compared with those that are told (0); a member may be both (2).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side_, node_, c_ = pdf["side"].to_numpy(), pdf["node"].to_numpy(), pdf["c"].to_numpy()
        s_, edges = np.stack(pdf["sketch"].to_numpy()).view(U64), []
        _, first, own = np.unique(node_, return_index=True, return_inverse=True)  # a node may lie in several tiles
        bodies = make(pdf["grams"].iloc[first].tolist())
        order, cut = _tiles(pdf)
        for t in range(len(cut) - 1):
            rows = order[cut[t] : cut[t + 1]]
            side, node, c, s, grams = side_[rows], node_[rows], c_[rows], s_[rows], [bodies[i] for i in own[rows]]
            size, sets = np.array([len(g) for g in grams]), Union()
            some, many = np.unique(c, return_counts=True)
            asks, told = (side == 1) | (side == 2) & (c != some[many.argmax()]), side != 1
            x, y, c = np.flatnonzero(asks), np.flatnonzero(told), c.tolist()
            if not len(x) or not len(y):
                continue
            ones = _ones(s[x], s[y])
            ok = (ones <= screen(size[x][:, None], size[y][None])) & (np.minimum(size[x][:, None], size[y][None]) * den >= np.maximum(size[x][:, None], size[y][None]) * num)
            ok &= ~(told[x][:, None] & asks[y][None] & (y[None] <= x[:, None]))  # two members that both ask and are told meet once
            for i, p in enumerate(x):
                at = np.flatnonzero(ok[i])
                for q in y[at[np.argsort(ones[i, at], kind="stable")]]:
                    if sets.find(c[p]) == sets.find(c[q]):
                        continue
                    both = shared_size(grams[p], grams[q])
                    if both * den >= (size[p] + size[q] - both) * num:
                        sets.join(c[p], c[q])
                        edges.append((node[p], node[q]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def in_bins(df: DataFrame, run, rows: int, schema: str = "a long, b long") -> DataFrame:
    """``run`` over whole tiles (key, one, two), many of them in a task's group; ``rows`` of ``df`` give the number of groups."""
    bins = F.pmod(F.xxhash64("key", "one", "two"), F.lit(max(256, rows // 2048))).cast("int")
    return df.groupBy(bins.alias("bin")).applyInPandas(run, schema)


class Bloom:
    """A Bloom filter of at most ``1 << most`` bits over the longs ``node``, which are hashes; two probes, each a part of the hash."""

    def __init__(self, nodes: DataFrame, most: int = 27):
        n = nodes.count()
        self.log = min(most, max(10, (16 * n).bit_length()))
        low = F.col("node").bitwiseAND(F.lit((1 << self.log) - 1))
        high = F.shiftrightunsigned("node", 64 - self.log)
        word = nodes.select(F.explode(F.array(low, high)).alias("x")).groupBy(F.shiftright("x", 6).cast("int").alias("word"))
        # at most 1 << (most - 6) rows, whatever the number of hashes
        rows = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(1 << max(0, self.log - 6), U64)
        self.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(U64)

    def test(self, key: str) -> Column:
        """Whether the long ``key`` may be held, for rows that are joined with ``table``."""
        low = F.col(key).bitwiseAND(F.lit((1 << self.log) - 1))
        test = F.lit(True)
        for probe in (low, F.shiftrightunsigned(key, 64 - self.log)):
            word = F.get("bloom", F.shiftright(probe, 6).cast("int"))
            test = test & (F.getbit(word, probe.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return test

    def table(self, spark: SparkSession) -> DataFrame:
        """The filter as one row."""
        return F.broadcast(spark.createDataFrame(pa.table({"bloom": pa.ListArray.from_arrays([0, len(self.words)], self.words.view(np.int64))})))

    def passing(self, df: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
        """Rows of ``df`` whose long ``key`` may be held (or, with ``left_anti``, is not); ``df`` is not shuffled."""
        return df.join(self.table(df.sparkSession), self.test(key), how)

    def may_hold(self, node: np.ndarray) -> np.ndarray:
        x = node.view(U64)
        out = np.ones(len(x), bool)
        for probe in (x & U64((1 << self.log) - 1), x >> U64(64 - self.log)):
            out &= (self.words[probe >> U64(6)] >> (probe & U64(63)) & U64(1)).astype(bool)
        return out


def nearly_semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key``, a hash, is in ``keys`` (durable), and perhaps some more; ``df`` is never shuffled."""
    if keys.count() * 16 <= BROADCAST_BYTES:
        return df.join(F.broadcast(keys), key, "left_semi")
    return Bloom(keys.select(F.col(key).alias("node"))).passing(df, key)


#: Keys that are packed at once; rows of ``sig`` for each part of their prints, and the most parts.
_PACK, _PART_ROWS, _MOST_PARTS = 1 << 19, 1 << 14, 1 << 12


def _prints(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key and its 32-bit print there, as one number."""
    x = mix(keys.view(U64))
    return (x & U64(0xFFFFFFFF)) % U64(parts) << U64(32) | x >> U64(32)


_PACKS = pa.schema([("part", pa.int32()), ("prints", pa.binary())])


def _pack(parts: int):
    """Batches of (bands) to packs of prints by part, in each pack a print twice at most, so that a hot key stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            x = np.sort(_prints(np.concatenate(held), parts))
            first = np.concatenate(([True], x[1:] != x[:-1]))
            x = x[first | np.append(False, first[:-1])]
            cut = np.searchsorted(x, np.arange(parts + 1, dtype=U64) << U64(32))
            data = pa.py_buffer((x & U64(0xFFFFFFFF)).astype(np.uint32))
            packs = pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer((cut * 4).astype(np.int32)), data])
            some = pa.array(np.diff(cut) > 0)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)).filter(some), packs.filter(some)], schema=_PACKS)

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= _PACK:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return run


def _repeated(packs: pa.Table) -> pa.Table:
    """Packs of one part to the names of the prints that come up again."""
    x = np.sort(np.frombuffer(b"".join(packs["prints"].to_pylist()), np.uint32))
    x = np.unique(x[1:][x[1:] == x[:-1]]).astype(U64)
    return pa.table({"node": mix(x | U64(packs["part"][0].as_py()) << U64(32)).view(np.int64)})


_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _again(bloom, parts: int):
    """Batches of (node, bands) to rows (key, node) of the keys whose print comes up again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands")
            key = bands.flatten().to_numpy()
            ok = bloom.value.may_hold(mix(_prints(key, parts)))
            node = np.repeat(batch.column("node").to_numpy(), bands.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(node[ok])], schema=_KEYS)

    return run


def repeated_keys(sig: DataFrame) -> DataFrame:
    """Rows ``(key, node)`` of the band keys of ``sig(node, bands)``, without nearly all keys that come up only once.

    Most do, so that only prints of all keys are dealt, four bytes each.  What comes up again goes into a Bloom filter;
    it may let other keys pass, but keeps all that are shared.
    """
    spark, parts = sig.sparkSession, min(_MOST_PARTS, max(8, sig.count() // _PART_ROWS))
    sig = sig.where("bands is not null")
    again = durable(sig.select("bands").mapInArrow(_pack(parts), "part int, prints binary").groupBy("part").applyInArrow(_repeated, "node long"))
    bloom = spark.sparkContext.broadcast(Bloom(again))
    out = durable(sig.select("node", "bands").mapInArrow(_again(bloom, parts), "key long, node long"))
    bloom.unpersist()
    free(again)
    return out


#: One node in so many is looked at for keys that many nodes share, and how often such a key must come up.
_ONE_IN, _OFTEN = 64, 64


_BUCKETS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("lo", pa.int64())])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node), sorted by key, to those of keys with several nodes, with one node of each key; keeps one row of a run at most."""

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 16:
                t = pa.Table.from_batches(held)
                yield t["key"].to_numpy(), t["node"].to_numpy()
                held, rows = [], 0
        if rows:
            t = pa.Table.from_batches(held)
            yield t["key"].to_numpy(), t["node"].to_numpy()

    wait = told = None  # the last run: its only node so far, or the node already given with it
    for k, n in chunks():
        if wait is not None:
            k, n = np.append(wait[0], k), np.append(wait[1], n)
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        lo, hi = np.minimum.reduceat(n, cut), np.maximum.reduceat(n, cut)
        shared = lo < hi
        if told is not None and told[0] == k[0]:
            lo[0], shared[0] = told[1], True
        last = (k[-1], lo[-1])
        wait, told = (None, last) if shared[-1] else (last, None)
        size = np.diff(np.append(cut, len(k)))
        own = np.repeat(shared, size)
        k, n, lo = k[own], n[own], np.repeat(lo, size)[own]
        order = np.lexsort((n, k))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(k[order]) != 0) | (np.diff(n[order]) != 0)
        order = order[new]
        yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (k, n, lo)], schema=_BUCKETS)


def shared_buckets(sig: DataFrame) -> DataFrame:
    """Members of the band keys of ``sig(node, bands)`` that several nodes share, ``(key, node, lo)``; ``lo`` is one of them.

    Band rows of keys that come up again are dealt by key once, sorted, and read in runs.  Keys of very many nodes, which
    a look at one node in ``_ONE_IN`` shows, are kept out of that deal: their smallest member is a pre-aggregated minimum,
    and their members stay where they are.
    """
    b = rows = repeated_keys(sig)
    hot = durable(rows.where(F.pmod(F.xxhash64("node"), F.lit(_ONE_IN)) == 0).groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") >= _OFTEN).select("key"))
    none = hot.isEmpty()
    if not none:
        b = join_by_size(rows, hot, "key", "left_anti")
    m = b.repartition("key").sortWithinPartitions("key").select("key", "node").mapInArrow(_shared, "key long, node long, lo long")
    if not none:
        h = durable(join_by_size(rows, hot, "key").distinct())
        low = durable(h.groupBy("key").agg(F.min("node").alias("lo")))
        m = m.union(join_by_size(h, low, "key").select("key", "node", "lo"))
    out = durable(m)
    free(rows, hot)
    if not none:
        free(h, low)
    return out


def native_check(num: int, den: int):
    """Pairs (a, b, ga, gb) with sets as arrays to those that link."""
    both = F.size(F.array_intersect("ga", "gb"))
    return lambda df: df.where(both * den >= (F.size("ga") + F.size("gb") - both) * num).select("a", "b")


def linked_components(
    m: DataFrame,
    sketches_of: Callable[[DataFrame], DataFrame],
    grams_of: Callable[[DataFrame], DataFrame],
    num: int,
    den: int,
    screen: Screen,
    check: Callable[[DataFrame], DataFrame] | None = None,
    make: Callable[[list], list[np.ndarray]] = as_sets,
    star_rounds: int = 2,
) -> DataFrame:
    """Components of all pairs of sets in a bucket with ``den * |A & B| >= num * |A | B|``; rows ``(node, component)``.

    ``m`` comes from ``shared_buckets``, ``sketches_of(nodes)`` gives ``(node, n, sketch)`` and ``grams_of(nodes)``
    ``(node, grams)`` with the whole sets, on which every link is confirmed (``check``, ``make``).  No bucket emits its pairs:

    1. Members of a bucket are compared with one centre each, for a few rounds.  Pairs inside one
       component need no comparison, so most large buckets are settled by this.
    2. In buckets that still hold several components, tiles of bounded size compare odd sketches of
       all members and return those that are close to one of another component, and a forest of
       close components: their families.
    3. In each family, tiles compare the whole sets of members outside its largest component with
       those of all members and return a forest of confirmed links.  Chains of close components may
       run through much of a table, and the tiles of such a family grow with its square: where its
       close members deal fewer rows bucket by bucket, tiles are made of these instead.
    """
    spark, check = m.sparkSession, check or native_check(num, den)
    comp = spark.createDataFrame([], "node long, component long")
    ends = lambda p: durable(p.select(F.col("a").alias("node")).union(p.select("b")).distinct())

    def confirm(pairs: DataFrame) -> DataFrame:
        nodes = ends(pairs)
        here = durable(sketches_of(nodes))
        side = lambda x: here.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        ones = sum((F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(screen.bits // 64)), F.lit(0))
        close = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
        close = durable(close.where(ones <= screen.columns("na", "nb")).select("a", "b"))
        wanted = ends(close)
        grams = durable(grams_of(wanted))
        ga, gb = (grams.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
        out = durable(check(close.join(ga, "a").join(gb, "b")))
        free(nodes, here, close, wanted, grams)
        return out

    def open_buckets() -> DataFrame:
        mc = m.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        several = mc.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 < c1 and size > 2")
        return durable(mc.join(several, "key"))

    for r in range(star_rounds):
        if r == 0:
            pairs = durable(m.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct())
        else:
            mc = open_buckets()
            centre = mc.where("c = c1").groupBy("key").agg(F.max("node").alias("z"))
            pairs = mc.join(centre, "key").where("c <> c1").select(F.least("z", "node").alias("a"), F.greatest("z", "node").alias("b"))
            pairs = durable(pairs.distinct())
            free(mc)
        new = confirm(pairs)
        links = new if r == 0 else new.union(comp.where("node <> component"))  # components so far are stars of links
        last, comp = comp, components(links)
        free(pairs, new, last)
        release(spark)

    mc = open_buckets()
    if mc.isEmpty():
        return comp
    blocks = lambda x, size: F.ceil(x / size).cast("int")
    nodes = durable(mc.select("node").distinct())
    here = durable(sketches_of(nodes))
    t = mc.withColumn("blocks", blocks(F.col("size"), SKETCH_BLOCK))
    rows = t.agg(F.sum("blocks")).first()[0]
    t = join_by_size(t, here, "node", row_bytes=256)
    t = t.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    t = t.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "c", "n", "sketch")
    close = durable(in_bins(t, sketch_tile(screen), rows, _CLOSE).distinct())
    if close.isEmpty():
        return comp
    family = components(close.where("key is null").select("a", "b"))
    release(spark)
    by_c = family.select(F.col("node").alias("c"), F.col("component").alias("family"))
    whole = join_by_size(mc.select("node", "c").distinct(), by_c, "c").select("family", F.lit(True).alias("whole"), F.col("family").alias("key"), "node", "c")
    parts = join_by_size(close.where("key is not null").select(F.col("key").alias("bucket"), F.col("a").alias("node"), F.col("b").alias("c")), by_c, "c")
    f = durable(whole.union(parts.select("family", F.lit(False).alias("whole"), F.xxhash64("bucket", "family").alias("key"), "node", "c")))
    top = f.groupBy("family", "whole", "key", "c").agg(F.count("*").alias("k")).groupBy("family", "whole", "key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("size"))
    top = top.select("family", "whole", "key", F.col("top.c").alias("top"), "size", (F.col("size") - F.col("top.k")).alias("rest"), blocks(F.col("size"), SET_BLOCK).alias("nb"), blocks(F.col("size") - F.col("top.k"), SET_BLOCK).alias("na"))
    top = top.withColumn("rows", F.when(F.col("nb") == 1, F.col("size")).otherwise(F.expr("size * na + rest * nb")))
    top = durable(top)
    both = top.groupBy("family").agg(F.coalesce(F.sum(F.when(F.col("whole"), F.col("rows"))), F.lit(0)).alias("x"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("rows"))), F.lit(0)).alias("y"))
    less = durable(top.join(both, "family").where("whole = (x <= y)").select("whole", "key", "top", "nb", "na", "rows"))
    rows = less.agg(F.sum("rows")).first()[0]
    g = durable(join_by_size(f, less.drop("rows"), ["whole", "key"], row_bytes=40).select("key", "node", "c", "top", "nb", "na"))
    wanted = durable(g.select("node").distinct())
    grams = durable(grams_of(wanted))
    body = g.join(nearly_semi(here.select("node", "sketch"), wanted, "node"), "node").join(grams, "node")
    tile = lambda one, two, side: F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), F.lit(side).alias("side"))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    ask = F.filter(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: tile(mine("na"), x, 1)), lambda _: F.col("c") != F.col("top"))
    told = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda x: tile(x, mine("nb"), 0))
    t = body.withColumn("tile", F.explode(F.when(F.col("nb") == 1, F.array(tile(F.lit(0), F.lit(0), 2))).otherwise(F.concat(ask, told))))
    t = t.select("key", "tile.one", "tile.two", "tile.side", "node", "c", "sketch", "grams")
    new = durable(in_bins(t, set_tile(screen, num, den, make), rows))
    out = comp if new.isEmpty() else components(new.union(comp.where("node <> component")))
    free(mc, nodes, here, close, family, f, top, less, g, wanted, grams, new)
    return out
