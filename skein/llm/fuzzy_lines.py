"""Line dedup over fuzzy lines: MinHash of character shingles, banding, exact Jaccard, distributed components.

A line (text between newlines) is lower-cased, one code point at a time, and its blanks collapsed; blank lines are always kept.
Lines link where their sets of 8-character shingles have a Jaccard similarity of 0.75 or more, and of each
component only the first line stays, by document id and position.  Candidates share one of 10 bands of
3 MinHash values (a pair at the threshold is missed with probability 0.004, at 0.85 with 7e-5); parity
bitmaps of their whole sets screen them, and the whole sets confirm them.

A line is named by a 64-bit hash of its normal form, so exact copies need no candidates at all.  Candidate
lines are read in a second pass over the texts, one document for each line, which Bloom filters of the
documents and of the places of lines guide, so texts are shuffled once only, where lines of a document go.

Defined edge cases: null texts stay null with no lines; a line of fewer than 8 characters is one
shingle; rows that repeat an id and text count as one document and get the same result; ids may be
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_COEF, Bloom, MinHash, Screen, durable, free, join_by_size, linked_components, mix, nearly_semi, pair_check, power_tables, release, shared_buckets

GRAM = 8
#: Bytes of texts whose lines are read at once.
BATCH = 1 << 17
#: What ``str.split`` takes for blanks.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_LOW = np.array([ord(chr(c).lower()[0]) for c in range(1 << 16)], np.uint32)
_BLANK = np.zeros(1 << 16, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
#: The same for code points below 256, which stay below it.
_LOW8, _BLANK8 = _LOW[:256].astype(np.uint8).tobytes(), _BLANK[:256].tobytes()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def low_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased text, one byte each if all are below 256, and which of them are blanks."""
    try:
        low = text.encode("latin-1").translate(_LOW8)
    except UnicodeEncodeError:
        x = codes(text)
        wide = x.max(initial=0) >= len(_LOW)
        x = np.where(x < len(_LOW), _LOW[np.minimum(x, len(_LOW) - 1)], x) if wide else _LOW[x]
        return x, _BLANK[np.minimum(x, len(_LOW) - 1) if wide else x]
    return np.frombuffer(low, np.uint8), np.frombuffer(low.translate(_BLANK8), bool)


def normal_codes(text: str) -> np.ndarray:
    """Code points of the text with all of its lines in normal form."""
    x, blank = low_codes(text)
    line = x == 10
    gap, after, before = blank & ~line, np.append(blank[1:], True), np.concatenate(([True], line[:-1]))
    if (gap & (after | before | (x != 32))).any():
        x = np.where(gap, x.dtype.type(32), x)[~(gap & after)]  # the last blank of a run stays, if a word follows
        x = x[~((x == 32) & np.concatenate(([True], x[:-1] == 10)))]
    return x


def said(x: np.ndarray) -> str:
    return x.tobytes().decode("latin-1") if x.dtype == np.uint8 else x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def normal(line: str) -> str:
    return said(normal_codes(line))


def grams_at(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``GRAM`` code points of the lines that begin at ``start``, and the cuts between lines.

    Repeats are not removed; a shorter (not empty) line is one run.
    """
    x = np.concatenate((x, np.zeros(GRAM, x.dtype))).astype(U64)
    x += U64(1)
    h, width = x, 1
    while width < GRAM:  # runs of 2, 4 and 8
        h, left = h[:-width] * WORD_COEF[width], h
        h += left[width:]
        width *= 2
    h = mix(h)
    short = size < GRAM
    if short.any():
        s, n = start[short], size[short]
        v = n.astype(U64)
        for j in range(GRAM - 1):
            v[n > j] += x[s[n > j] + j] * WORD_COEF[j]
        h[s] = mix(v)
    count = np.where(short, 1, size - GRAM + 1)
    step = np.zeros(len(h) + 1, np.int8)
    step[start], step[start + count] = 1, -1
    return h[np.cumsum(step[:-1], dtype=np.int8).view(bool)], np.concatenate(([0], np.cumsum(count)))


def names_of(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of lines by their code points."""
    up, down = power_tables(len(x) + 1)
    v = x * WORD_COEF[61]
    v ^= v >> U64(29)
    v *= up[: len(x)]
    sums = np.zeros(len(x) + 1, U64)
    np.cumsum(v, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * WORD_COEF[60]).view(np.int64)


class Lines:
    """Lines that are not blank of a column of texts (no nulls): ``doc`` (number of the text), ``pos``, ``node``."""

    def __init__(self, texts: pa.Array, first: int):
        self.x = x = normal_codes(pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "\n")[0].as_py() + "\n")
        end = np.flatnonzero(x == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        per = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False).astype(np.int64) + 1
        doc, full = np.repeat(np.arange(len(texts)), per), end > start
        self.doc, self.pos = doc[full] + first, (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))[full]
        self.start, self.end = start[full], end[full]
        self.node = names_of(x, self.start, self.end)

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the lines of a mask, and the cuts between lines."""
        step = np.zeros(len(self.x) + 1, np.int8)
        a, b = self.start[which], self.end[which]
        step[a] += 1
        step[b + 1] -= 1  # with the line's end
        size = b - a
        return grams_at(self.x[np.cumsum(step[:-1], dtype=np.int8).view(bool)], np.cumsum(size + 1) - size - 1, size)


def lines_of(texts: pa.Array) -> Iterator[Lines]:
    """``Lines`` of about ``BATCH`` bytes of texts at a time."""
    texts = pc.fill_null(texts, "")
    sums, i = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + BATCH, side="right")))
        yield Lines(texts[i:j], i)
        i = j


class Fresh:
    """Names not met before in this task; what it remembers is bounded."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, node: np.ndarray) -> np.ndarray:
        """A mask of the first place of each name that is new."""
        names, first = np.unique(node, return_index=True)
        new = np.array([x not in self.seen for x in names.tolist()], bool)
        self.seen.update(names[new].tolist())
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        out = np.zeros(len(node), bool)
        out[first[new]] = True
        return out


def doc_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def place(dk, pos):
    """A hash of a line's place by its document's key and its position (longs of numpy, or columns)."""
    if isinstance(dk, Column):
        return dk.bitwiseXOR(pos).bitwiseXOR(F.shiftleft(pos, 41))
    return dk ^ pos ^ (pos << 41)


LINE = pa.schema([("dk", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("node", pa.int64()), ("own", pa.bool_()), ("bands", pa.list_(pa.int64()))])


def signer(bands: int, rows: int):
    """Batches of (dk, id, text) to lines (dk, id, pos, node, own, bands); the first of a node in a task is its own and carries its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mh, fresh = MinHash(bands, rows), Fresh()
        for batch in batches:
            for c in lines_of(batch.column("text")):
                own = fresh(c.node)
                keys = mh.keys(mh.minima_of(*c.grams(own))).ravel() if own.any() else np.empty(0, np.int64)
                ends = pa.array(np.concatenate(([0], np.cumsum(own * bands))), pa.int32())
                none = pa.array(np.append(~own, False))
                lists = pa.ListArray.from_arrays(pc.if_else(none, pa.scalar(None, pa.int32()), ends), pa.array(keys))
                doc = pa.array(c.doc)
                yield pa.RecordBatch.from_arrays([batch.column("dk").take(doc), batch.column("id").take(doc), pa.array(c.pos, pa.int32()), pa.array(c.node), pa.array(own), lists], schema=LINE)

    return run


def distinct_sets(grams: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingles (48 bits of their hashes) of each line, by sorts of (line, hash) over many lines."""
    out: list[np.ndarray] = []
    for i in range(0, len(cut) - 1, 1 << 12):
        at = cut[i : i + (1 << 12) + 1]
        key = grams[at[0] : at[-1]] >> U64(16)
        key |= np.repeat(np.arange(len(at) - 1, dtype=U64) << U64(48), np.diff(at))
        key.sort()
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        key = key[first]
        out += np.split(key & U64((1 << 48) - 1), np.searchsorted(key, np.arange(1, len(at) - 1, dtype=U64) << U64(48)))
    return out


def distinct_grams(lines: list[str]) -> list[np.ndarray]:
    """``distinct_sets`` of (not empty) lines in normal form."""
    size = np.array([len(x) for x in lines], np.int64)
    return distinct_sets(*grams_at(codes("\n".join(lines)), np.cumsum(size + 1) - size - 1, size)) if lines else []


def parity(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Odd sketches of whole sets: bit ``h mod bits`` is toggled by every element."""
    h = np.concatenate(sets)
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n = np.bincount(at * bits + (h % U64(bits)).astype(np.int64), minlength=len(sets) * bits)
    return np.packbits((n & 1).astype(np.uint8).reshape(len(sets), bits), axis=1).view(np.int64)


BODY = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("sketch", pa.list_(pa.int64())), ("grams", pa.string())])


def wanted_lines(bloom, bits: int):
    """Batches of (dk, text) to the normal forms of lines whose ``place`` the filter may hold, with size and odd sketch of their sets, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in batches:
            # only the lines asked for are brought to normal form
            parts = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
            per, lines = parts.value_lengths().to_numpy(), parts.flatten()
            pos = np.arange(len(lines)) - np.repeat(np.cumsum(per) - per, per)
            held = bloom.value.may_hold(place(np.repeat(batch.column("dk").to_numpy(), per), pos))
            for c in lines_of(lines.filter(pa.array(held))):
                own = fresh(c.node)
                if not own.any():
                    continue
                sets = distinct_sets(*c.grams(own))
                sketch, lines = parity(sets, bits), [said(c.x[a:b]) for a, b in zip(c.start[own], c.end[own], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * sketch.shape[1]), pa.array(sketch.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(c.node[own]), pa.array([len(s) for s in sets], pa.int32()), lists, pa.array(lines, pa.string())], schema=BODY)

    return run


def keep_lines(text: Column, drop: Column) -> Column:
    parts = F.split(text, "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.array_contains(drop, i))
    return F.when(drop.isNull(), text).otherwise(F.array_join(kept, "\n"))


def signed_once(sig: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(node, bands)`` of ``sig``; of a node in ``several(node, first)``, only those of the document ``first``. The second is to be freed."""
    rows, held = sig.where("own").select("node", "dk", "bands"), Bloom(several)
    some = join_by_size(held.passing(rows, "node"), several, "node", "left", row_bytes=24).where("first is null or dk = first")
    some = durable(some.select("node", "bands"))
    return held.passing(rows, "node", "left_anti").select("node", "bands").union(some), some


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100, bands: int = 10, rows: int = 3, bits: int = 512) -> DataFrame:
    """One row per document: ``id_col, text`` without repeated lines, ``n_lines`` (not blank), ``n_dropped``."""
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(doc_key(F.col("id"), F.col("text")).alias("dk"), "id", "text")
    sig = durable(text.mapInArrow(signer(bands, rows), "dk long, id long, pos int, node long, own boolean, bands array<long>"))

    # lines that come up again; where several tasks have signed one, its band keys are taken from one document
    again = sig.groupBy("node").agg(F.count("*").alias("k"), F.count_if("own").alias("signed"), F.min(F.when(F.col("own"), F.col("dk"))).alias("first"))
    again = durable(again.where("k > 1").select("node", "signed", "first"))
    signed, some = signed_once(sig, again.where("signed > 1").select("node", "first"))
    m = shared_buckets(signed)
    lines = durable(sig.select("dk", "id", "pos", "node"))
    free(sig, some)
    release(spark)
    nodes = durable(m.select("node").distinct())
    # of the documents that hold a candidate line, the one of the smallest key is read for it
    homes = nearly_semi(lines.select("node", "dk", "pos"), nodes, "node").groupBy("node").agg(F.min_by(F.col("pos").cast("long"), "dk").alias("pos"), F.min("dk").alias("dk"))
    homes = durable(homes)
    home, bloom = Bloom(homes.select(F.col("dk").alias("node"))), spark.sparkContext.broadcast(Bloom(homes.select(place(F.col("dk"), F.col("pos")).alias("node"))))
    body = home.passing(text.select("dk", "text"), "dk").mapInArrow(wanted_lines(bloom, bits), "node long, n int, sketch array<long>, grams string")
    body = durable(body.withColumn("at", F.monotonically_increasing_id()))
    bloom.unpersist()
    # a line that the filter let pass in several documents, or of a repeated row, is taken where it came first
    twice = durable(body.groupBy("node").agg(F.min("at").alias("first"), F.count("*").alias("k")).where("k > 1").select("node", "first"))
    once = lambda df: join_by_size(df, twice, "node", "left", row_bytes=24).where("first is null or at = first").drop("at", "first")
    of = lambda *columns: lambda nodes: once(nearly_semi(body.select("node", "at", *columns), nodes, "node"))
    check = lambda df: df.mapInPandas(pair_check(num, den, distinct_grams), "a long, b long")
    comp = linked_components(m, of("n", "sketch"), of("grams"), num, den, Screen(num, den, bits=bits), check, distinct_grams, star_rounds=1)
    free(m, nodes, homes, body, twice)
    release(spark)

    # places of lines that occur again or have a component; all other lines stay
    often = durable(again.select("node").join(comp, "node", "full").select("node", F.coalesce("component", "node").alias("cls")))
    places = durable(join_by_size(nearly_semi(lines, often, "node"), often, "node").select("dk", "id", "pos", "cls"))
    free(lines, again, often, comp)
    head = places.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull(), "id", "pos", "dk")).alias("head"))
    head = durable(head.select("cls", F.col("head.dk").alias("hk"), F.col("head.pos").alias("hp")))
    gone = join_by_size(places, head, "cls", row_bytes=24).where("dk <> hk or pos <> hp").groupBy("dk").agg(F.collect_set("pos").alias("gone"))
    gone = durable(gone)
    free(places, head)
    release(spark)
    # texts that lose no line need no shuffle; the filter decides which those are, the join what the others lose
    held = Bloom(gone.select(F.col("dk").alias("node")))
    some = held.passing(text, "dk").join(gone, "dk", "left")
    out = some.unionByName(held.passing(text, "dk", "left_anti").withColumn("gone", F.lit(None).cast("array<int>")))
    n = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.ltrim(x, F.lit(BLANKS)) != ""))
    return out.select(
        F.col("id").alias(id_col), keep_lines(F.col("text"), F.col("gone")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped"),
    )
