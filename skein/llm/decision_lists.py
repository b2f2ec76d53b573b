"""Quality rules: learned decision lists over document statistics.

Every whole text becomes counts of its words, characters and lines.  Texts that fail the base rules (too few words, or
over half of the words in repeated runs of three) are dropped.  For the others a decision list is learned from labelled rows
by sequential covering: a rule, a conjunction of thresholds on ratios of the counts, grows on two thirds of the rows by
FOIL's gain, loses the conditions at its end that do not help on the other third, and is kept if the rows it covers
are bad often enough; then its rows go and the next rule follows.  The list becomes one Spark ``CASE WHEN`` over the
counts, whose first true condition decides; where none holds, the document stays.

Labels are learnt only from rows whose ``crc32(id as text) mod 5`` is not 0, of which at most ``max_rows``
ids (by hash of the id) are taken; labels, lang, source and id are no inputs of a verdict.

Defined edge cases: null and empty texts have all counts 0, which fails the base rules; the largest label of an id counts, null ones are
ignored, and of rows that share an id one is learned from; with fewer than two classes, or nothing that holds often enough, the list is empty and all
that pass the base rules stay; ties in gain go to the earlier ratio, then to ``>=``, then to the smaller threshold; very long texts are counted whole; repeated
rows stay repeated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_COEF, durable, mix, word_chunks
from .quality_gbt import fold

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_open_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_top")
#: Ratios that conditions speak of: name, count above, count below.
RATIOS = (
    ("word_length", "word_chars", "n_words"), ("symbols", "n_symbols", "n_words"), ("marks", "n_marks", "n_words"), ("upper", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"), ("open_lines", "n_open_lines", "n_lines"), ("line_words", "n_words", "n_lines"), ("repeats", "n_repeat_words", "n_words"), ("distinct", "n_distinct", "n_words"), ("top_word", "n_top", "n_words"),
)
_SPACE = " \t\n\x0b\f\r"
#: Classes of bytes: 0 blanks, 1 bytes that continue a code point, 2 symbols, 3 capitals, 4 digits, 5 ``!`` and ``?``, 6 the rest.
_CLASS = np.full(256, 6, np.int64)
_CLASS[list(_SPACE.encode())], _CLASS[0x80:0xC0], _CLASS[list(b"#*$%&|<>")], _CLASS[65:91], _CLASS[48:58], _CLASS[list(b"!?")] = 0, 1, 2, 3, 4, 5


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    w = mix(words[:-2] * WORD_COEF[0] + words[1:-1] * WORD_COEF[1] + words[2:] * WORD_COEF[2])
    _, at, n = np.unique(w, return_inverse=True, return_counts=True)
    again = n[at] > 1
    held = np.zeros(len(words), bool)
    for k in range(3):
        held[k : k + len(again)] |= again
    return int(held.sum())


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of ``COUNTS`` for each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for a, h, cut in word_chunks(texts, lambda t: t.encode("utf-8", "surrogatepass")):
        for k in range(len(cut) - 1):
            t, w = texts[a + k], h[cut[k] : cut[k + 1]].astype(U64)
            if not t:
                continue
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            c = np.bincount(_CLASS[raw], minlength=7)
            lines = [x for x in t.split("\n") if x.strip(_SPACE)]
            open_ = sum(x.rstrip(_SPACE)[-1] not in ".!?" for x in lines)
            _, n = np.unique(w, return_counts=True)
            out[a + k] = (len(w), c[2:].sum(), c[2], len(lines) - len(set(lines)), repeated_words(w), len(lines), open_, c[3], c[4], c[5], len(n), n.max(initial=0))
    return out


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def ratio(above: str, below: str) -> Column:
    """A ratio of counts; 0 where there is nothing to divide by."""
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    """``ratio >= cut`` or ``ratio < cut``."""

    ratio: int
    high: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.ratio] >= self.cut) == self.high

    def column(self) -> Column:
        c = ratio(*RATIOS[self.ratio][1:])
        return c >= self.cut if self.high else c < self.cut

    def __str__(self) -> str:
        return f"{RATIOS[self.ratio][0]} {'>=' if self.high else '<'} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions that drop a document; without any, it stays."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    covered: list[tuple[int, int]] = field(default_factory=list)  # bad and good training rows of each rule

    def rule_column(self) -> Column:
        """Number of the first rule that holds, from 1; 0 for none."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            all_ = rule[0].column()
            for c in rule[1:]:
                all_ &= c.column()
            out = F.when(all_, k) if out is None else out.when(all_, k)
        return F.lit(0) if out is None else out.otherwise(0)

    def decide(self, x: np.ndarray) -> np.ndarray:
        """The same numbers for rows of ratios."""
        out = np.zeros(len(x), np.int64)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out[_holds(rule, x)] = k
        return out

    def __str__(self) -> str:
        said = [f"{k}. drop if {' and '.join(map(str, r))}  [{bad} bad, {good} good]" for k, (r, (bad, good)) in enumerate(zip(self.rules, self.covered, strict=True), 1)]
        return "\n".join([*said, "else keep"])


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int) -> list[Condition]:
    """Conditions added one by one, each with the best FOIL gain over what the rule covers so far."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best, add = 1e-9, None
        for f, edge in enumerate(cuts):
            if not len(edge):
                continue
            bins = np.searchsorted(edge, x[inside, f], "right")  # rows in bin b have b edges at or below their value
            b = np.bincount(bins, bad[inside], len(edge) + 1)
            a = np.bincount(bins, minlength=len(edge) + 1)
            above = (b[::-1].cumsum()[::-1][1:], a[::-1].cumsum()[::-1][1:])
            for high, (pb, all_) in ((True, above), (False, (p - above[0], p + n - above[1]))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pb > 0, pb * (np.log2(pb / all_) - np.log2(p / (p + n))), 0)
                k = int(gain.argmax())
                if gain[k] > best + 1e-9:
                    best, add = gain[k], Condition(f, high, float(edge[k]))
        if add is None:
            break
        rule.append(add)
        inside &= add.holds(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 24, most_conditions: int = 4, edges: int = 256, precision: float = 0.8, support: int = 5) -> DecisionList:
    """Sequential covering of the rows marked ``bad``; rows come in a fixed order, every third one prunes."""
    out, left = DecisionList(), np.ones(len(x), bool)
    if not bad.any() or bad.all():
        return out
    prune = np.arange(len(x)) % 3 == 2
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) <= edges else np.unique(np.quantile(mid, np.linspace(0, 1, edges))))
    while len(out.rules) < most_rules and (left & bad).any():
        rule = _grow(x[left & ~prune], bad[left & ~prune], cuts, most_conditions)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            at = _holds(r, x) & left & prune
            p, n = (at & bad).sum(), (at & ~bad).sum()
            return (p - n) / (p + n + 2)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        at = _holds(rule, x) & left
        p, n = int((at & bad).sum()), int((at & ~bad).sum())
        if p < support or (p + 1) / (p + n + 2) < precision:
            break
        out.rules.append(tuple(rule))
        out.covered.append((p, n))
        left &= ~at
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *COUNTS)`` of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf[["id"]], pd.DataFrame(counts(pdf["text"].tolist()), columns=list(COUNTS))], axis=1)

    # the id goes as text: a long column with nulls would come as floating point
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return out.mapInPandas(run, "id string, " + ", ".join(f"{c} long" for c in COUNTS))


def train(stats: DataFrame, labels: DataFrame, id_col: str, label: str, max_rows: int) -> DecisionList:
    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id")) != 0))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    ratios = F.struct(F.xxhash64(*COUNTS).alias("of"), *[ratio(a, b).alias(n) for n, a, b in RATIOS])
    rows = stats.where(~base_failed()).join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min(ratios).alias("x"))  # max_rows bounds the broadcast and the answer
    pdf = rows.select("id", "label", "x.*").toPandas().sort_values(["of", "id"])
    return learn(pdf[[n for n, _, _ in RATIOS]].to_numpy(float), pdf["label"].to_numpy() <= 0)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = 40_000) -> DataFrame:
    """One row per document: ``id_col, *COUNTS, base_failed, rule`` (the rule that drops it, 0 for none) and ``kept``."""
    stats = durable(statistics(docs, id_col, text_col))
    rules = train(stats, labels, id_col, label, max_rows)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(rules.rule_column()))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *COUNTS, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
