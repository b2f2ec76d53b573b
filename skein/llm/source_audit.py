"""Divergence of sources within a language, from joint histograms of term counts.

A term is a run of characters outside ``[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]``, A-Z lower-cased.  A language keeps the ``V`` terms of
at least ``min_docs`` of its documents.  A source (and the language) gives a kept term that it holds ``count`` times, 0 included,
``p = 1 + floor(10^9 (count + 1) / (N + V))`` with ``N`` the sum of its counts.  The divergence of ``p`` from ``q`` is
``f = floor((p - q)^2 / q)``, in whole numbers throughout.

``p`` depends on the count alone, so a pair of sources needs only the number of terms of each combination (count, count): tasks tally
the combinations of terms that both hold, vectorised over the terms of a batch, and give each combination once; cells
where one source has none come from the sources' own histograms less what the tallies hold, and the cell where both have none
from ``V``.  ``f`` is evaluated once per combination and multiplied by how often it occurs.  No row is made per term and pair.

Defined edge cases: null text, lang and source read as empty; a source without terms is compared like any other; a language with
one source has no pairs; without kept terms every pair has value 0; ties in value are ordered by item (UTF-8); repeated rows count as documents of their own;
an empty table gives an empty result; extra columns are ignored; very long texts are counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small_batches

SCALE = 1_000_000_000
#: Bytes to terms: capitals lowered, what belongs to no term a blank.
_TERMS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Terms and combinations that a task holds before it gives them on.
_TERMS_HELD, _HELD = 1 << 19, 1 << 18
_DOCS = 40
_DOC, _LOW = 1 << _DOCS, (1 << _DOCS) - 1

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to counts of terms and of documents with them, per group; an empty term counts the group itself."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences and, above bit 40, documents

    def give() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in held.items():
            k, said = len(n), pa.array(list(n), pa.binary()).cast(pa.string())
            both = np.fromiter(n.values(), np.int64, k)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), said, pa.array(both & _LOW), pa.array(both >> _DOCS)], schema=_COUNTS)
        held.clear()

    size = chars = 0
    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = Counter(text.encode("utf-8", "surrogatepass").translate(_TERMS).split(b" "))
            own[b""] = 0
            n = held.setdefault((lang, source), {})
            size, chars, had = size - len(n), chars + len(text), n.get
            for term, count in own.items():
                n[term] = had(term, 0) + count + _DOC
            size += len(n)
        if size >= _TERMS_HELD or chars >= _LOW:
            yield from give()
            size = chars = 0
    yield from give()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term; a row with an empty term for each group."""
    small_batches(docs.sparkSession)
    some = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(some(lang_col, "lang"), some(source_col, "source"), some(text_col, "text"))
    parts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE (count + 1) / (total + terms))``, exact."""
    dec = lambda c: c.cast("decimal(20,0)")
    return F.expr("1L") + F.call_function("div", dec(F.lit(SCALE)) * dec(count + 1), dec(total + terms))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


_TALLY = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("ca", pa.int64()), ("cb", pa.int64()), ("m", pa.int64())])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept terms with their sources, as (lang, sources, counts) with sources ascending, to combinations (lang, a < b, count, count) and their number."""
    parts: dict[str, list[np.ndarray]] = {}
    size = 0

    def fold(rows: list[np.ndarray]) -> np.ndarray:
        """Rows (a, b, ca, cb, m) with equal combinations added up."""
        x = np.concatenate(rows)
        x = x[np.lexsort(x[:, :4].T[::-1])]
        at = np.flatnonzero(np.concatenate(([True], (x[1:, :4] != x[:-1, :4]).any(1))))
        return np.column_stack((x[at, :4], np.add.reduceat(x[:, 4], at)))

    def give() -> Iterator[pa.RecordBatch]:
        for lang, rows in parts.items():
            x = fold(rows)
            for i in range(0, len(x), 1 << 16):
                y = x[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(y)), *(pa.array(y[:, j]) for j in range(5))], schema=_TALLY)
        parts.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        sources, counts = batch.column(1), batch.column(2)
        cut, s, c = sources.offsets.to_numpy(), sources.values.to_numpy(), counts.values.to_numpy()
        width = np.diff(cut)
        for lang in dict.fromkeys(langs):
            mine = langs == lang
            for k in np.unique(width[mine & (width > 1)]):
                # all terms held by k sources at once, some at a time: row t, source i of k
                first = cut[:-1][mine & (width == k)]
                i, j = np.triu_indices(k, 1)
                step = max(1, _HELD // len(i))
                for t in range(0, len(first), step):
                    f = first[t : t + step, None]
                    own = fold([np.column_stack([x[f + y].ravel() for x, y in ((s, i), (s, j), (c, i), (c, j))] + [np.ones(len(f) * len(i), np.int64)])])
                    parts.setdefault(lang, []).append(own)
                    size += len(own)
                    if size >= 4 * _HELD:
                        parts[lang] = [fold(parts[lang])]
                        size = sum(len(x) for rows in parts.values() for x in rows)
                        if size >= 2 * _HELD:
                            yield from give()
                            size = 0
    yield from give()


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each other source (``pair``), and the ``top`` terms that the source holds above its language (``term``)."""
    spark = docs.sparkSession
    counts = durable(term_counts(docs, lang_col, source_col, text_col))
    # sources by number within their language, in the order of their names; a language's groups are few against its terms
    groups = counts.where("term = ''").select("lang", "source").withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    groups = durable(groups)
    held = counts.where("term <> ''").join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("s", "n"))).alias("at"))
    kept = durable(held.where(F.col("docs") >= min_docs).select("lang", "term", "n", F.col("at.s").alias("s"), F.col("at.n").alias("c")))
    of_lang = durable(kept.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("v")))
    each = kept.select("lang", "term", "n", F.explode(F.arrays_zip("s", "c")).alias("x")).select("lang", "term", "n", "x.s", "x.c")
    # how many kept terms a source holds so many times
    hist = durable(each.groupBy("lang", "s", "c").agg(F.count("*").alias("m")))
    sums = hist.groupBy("lang", "s").agg(F.sum(F.col("c") * F.col("m")).alias("total"), F.sum("m").alias("terms"))
    groups = durable(groups.join(sums, ["lang", "s"], "left").join(of_lang.select("lang", "v"), "lang", "left").na.fill(0, ["total", "terms", "v"]))

    pairs = _pairs(groups, hist, kept)
    terms = _terms(each, groups, of_lang)
    rank = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs, terms = rank(pairs).withColumn("part", F.lit("pair")), rank(terms).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    cols = [F.col("lang").alias(lang_col), F.col("source").alias(source_col), "part", "item", "value", "rank"]
    return pairs.select(*cols).union(terms.select(*cols))


def _pairs(groups: DataFrame, hist: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every two sources of a language, both ways; as many rows as the result has."""
    one = groups.select("lang", F.col("s").alias("a"), F.col("source").alias("sa"), F.col("total").alias("na"), F.col("terms").alias("ta"), "v")
    two = groups.select("lang", F.col("s").alias("b"), F.col("source").alias("sb"), F.col("total").alias("nb"), F.col("terms").alias("tb"))
    pairs = durable(one.join(two, "lang").where("a < b"))
    both = kept.where(F.size("s") > 1).select("lang", "s", "c").mapInArrow(_tally, "lang string, a long, b long, ca long, cb long, m long")
    both = both.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    # cells with one count of 0: all terms that a source holds so often, less those that the other holds too
    of = lambda x, y, cx, cy: pairs.select("lang", "a", "b").join(hist.withColumnsRenamed({"s": x, "c": cx}), ["lang", x]).select("lang", "a", "b", F.col(cx), F.lit(0).cast("long").alias(cy), "m").select("lang", "a", "b", "ca", "cb", "m")
    none = pairs.select("lang", "a", "b", F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb"), (F.col("v") - F.col("ta") - F.col("tb")).alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    ca, cb, m = F.col("ca"), F.col("cb"), F.col("m")
    four = F.inline(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m)))
    cells = both.select("lang", "a", "b", four).union(of("a", "b", "ca", "cb")).union(of("b", "a", "cb", "ca")).union(none)
    cells = cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")
    x = cells.join(pairs, ["lang", "a", "b"])
    x = x.withColumns({"p": probability(F.col("ca"), F.col("na"), F.col("v")), "q": probability(F.col("cb"), F.col("nb"), F.col("v"))})
    worth = lambda p, q: F.sum(divergence(F.col(p), F.col(q)).cast("decimal(38,0)") * F.col("m")).cast("long")
    out = x.groupBy("lang", "a", "b").agg(worth("p", "q").alias("there"), worth("q", "p").alias("back"))
    out = pairs.join(out, ["lang", "a", "b"], "left").na.fill(0, ["there", "back"])
    way = lambda x, y, v: F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(v).alias("value"))
    return out.select("lang", F.inline(F.array(way("sa", "sb", "there"), way("sb", "sa", "back"))))


def _terms(each: DataFrame, groups: DataFrame, of_lang: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of the kept terms that a source holds above its language."""
    x = each.join(groups.select("lang", "s", "source", F.col("total").alias("own")), ["lang", "s"]).join(of_lang, "lang")
    x = x.withColumns({"p": probability(F.col("c"), F.col("own"), F.col("v")), "q": probability(F.col("n"), F.col("total"), F.col("v"))}).where("p > q")
    return x.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
