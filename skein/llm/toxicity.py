"""Toxicity behind disguise: a noisy channel is decoded first, then the restored words are scored.

The channel writes letters as look-alikes (``1d10t``), repeats them (``stuuupid``) and spaces words out
(``m o r o n``, ``s.c.u.m``).  A disguised token becomes a lattice of the letters each sign may stand for,
which Viterbi decodes under a character trigram model counted over the whole corpus; of the pairs of
letters that a prefix may end with, the ``BEAM`` best go on, which makes long lattices of ``*`` approximate.  Tokens of plain
letters and plain numbers stand for themselves, so only odd tokens are decoded, once per worker.  A token of
joined words gives its parts too; parts of more than 40 signs are cut into words in overlapping pieces.

The scorer reads restored words as word and prefix features.  Those that mark label 1 in the training rows
beyond chance are kept with their log-odds, but for those that a kept prefix covers; a word counts by its
strongest feature, and a text's score is the noisy or of its words' features.  Labels are learnt only from rows whose ``crc32(id as text) mod 5`` is not 0, at
most ``max_rows`` of them; labels, lang, source and id are no inputs.

Defined edge cases: null and empty texts have no words and get ``NO_MARK``; the largest
label of an id counts, null ones are ignored; with no toxic training row every score is 0; repeated
rows stay repeated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .quality_gbt import fold, training_rows

LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçîïôùûœñáíóúì"
#: The letters that a sign may stand for.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
_BREAKS = frozenset(" .-_*,'~^/\\")
_CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
_N = len(LETTERS) + 2  # 0: word boundary, 1: any other letter
_LUT = np.zeros(0x250, np.int64)
for _c, _i in _CODE.items():
    _LUT[ord(_c)] = _i
for _o in range(0xC0, 0x250):
    if chr(_o).isalpha() and not _LUT[_o]:
        _LUT[_o] = 1
_TRIM = re.compile(r"^[^\w@$(]+|[^\w@$]+$|[$@(]{3,}$|^[$@(]{3,}")
_RUN = re.compile(r"(.)\1+")
#: What joins words into one token.
_JOINT = re.compile(r"[^\w@$!|+(*€]+|_+")
#: A plain number, price, date or time stands for itself.
_NUMBER = re.compile(r"[$€+(-]*\d[\d.,:/()+%€-]*")
_KEPT, _LONG = 60_000, 40
#: Features that a task gives on at once; longest token that it remembers.
_GIVEN, _REMEMBERED = 1 << 15, 256
#: States of the decoder kept after each sign.
BEAM = 24
#: Score of a text without any toxic feature.
NO_MARK = 0.01


class Channel:
    """The trigram model and the decoder."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(_N, _N, _N).astype(float)
        c2 = c3.sum(0)
        c1 = c2.sum(0)
        p1 = (c1 + 1) / (c1.sum() + _N)
        p2 = (c2 + 20 * p1[None]) / (c2.sum(1, keepdims=True) + 20)
        self.log = np.log((c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)).tolist()
        self.known: dict[str, tuple[str, ...]] = {}
        # tokens that scoring has looked at in this worker, and those of them that hold a toxic word, with its strongest feature
        self.seen: set[str] = set()
        self.marked: dict[str, dict[str, str]] = {}

    def decode(self, signs: str, spaced: bool = False) -> str:
        """Most likely letters (and, if ``spaced``, word boundaries) behind ``signs``."""
        beam, last = {(0, 0): (0.0, "")}, ""
        for c in signs:
            options: list[tuple[int, str, float]] = []  # code, letter, cost
            if c in _CODE:
                options.append((_CODE[c], c, 0.0))
            elif c in LOOKALIKE:
                options += [(_CODE[x], x, 1.0 + (c == "*")) for x in LOOKALIKE[c]]
                options.append((-1, "", 12.0 if c.isdigit() else 5.0))
            elif c.isalpha():
                options.append((1, c, 0.0))
            else:
                options.append((-1, "", 0.5))
            if c == last and c not in _BREAKS:
                options.append((-1, "", 0.2))
            last = c
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (s, text) in beam.items():
                ways = [((a, b), s, text)]
                if spaced and b:
                    ways.append(((b, 0), s + self.log[a][b][0], text + " "))
                for (p, q), t, said in ways:
                    for code, x, cost in options:
                        key, val = ((p, q), t - cost) if code < 0 else ((q, code), t - cost + self.log[p][q][code])
                        if key not in new or val > new[key][0]:
                            new[key] = (val, said + x)
            beam = dict(sorted(new.items(), key=lambda x: -x[1][0])[:BEAM])
        return max(((s + self.log[a][b][0], text) for (a, b), (s, text) in beam.items()))[1]

    def words(self, token: str) -> tuple[str, ...]:
        """The restored words of a lower-cased token, runs of a letter squeezed."""
        if len(token) > _REMEMBERED:
            return self._words(token)
        if token not in self.known:
            if len(self.known) > _KEPT:
                self.known.clear()
            self.known[token] = self._words(token)
        return self.known[token]

    def _words(self, token: str) -> tuple[str, ...]:
        t = _TRIM.sub("", token)
        if not t.isascii():
            t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf").lower()
        if t.isalpha():
            if any(len(m[0]) > 2 for m in _RUN.finditer(t)):
                return tuple(dict.fromkeys(squeeze(w) for w in self._pieces(t)))
            return (squeeze(t),)
        if _NUMBER.fullmatch(t):
            return ()
        parts = [x for x in _JOINT.split(t) if x]
        out = []
        if len(t) <= _LONG:
            out.append(self._one(t))
        else:  # too long for one word: single signs between separators are spaced-out words
            run: list[str] = []
            for x in [*parts, "  "]:
                if len(x) == 1:
                    run.append(x)
                    continue
                if len(run) >= 4:
                    out += self.spaced("".join(run))
                run = []
        if len(parts) > 1 or len(t) > _LONG:
            for x in parts:
                if len(x) > 1 and not _NUMBER.fullmatch(x):
                    out += self._pieces(x)
            out += re.findall(r"[^\W\d_]{2,}", t)
        return tuple(dict.fromkeys(w for w in map(squeeze, out) if w))

    def _one(self, t: str) -> str:
        """One word: decoded if it holds two letters or look-alikes at least."""
        if t.isalpha() and not any(len(m[0]) > 2 for m in _RUN.finditer(t)):
            return t
        return self.decode(t) if sum(c.isalpha() or c in LOOKALIKE for c in t) > 1 else ""

    def _pieces(self, t: str) -> list[str]:
        """A part as one word; a long one is cut into words by the decoder."""
        if len(t) <= _LONG or t.isalpha() and not any(len(m[0]) > 2 for m in _RUN.finditer(t)):
            return [self._one(t)]
        return self.spaced(t)

    def spaced(self, signs: str) -> list[str]:
        """Words of a run of signs without boundaries; long runs in pieces that overlap."""
        return [w for a in range(0, len(signs), 64) for w in self.decode(signs[max(0, a - 12) : a + 64], True).split()]

    def restore(self, text: str | None) -> list[str]:
        """The restored words of a text; a run of four or more single signs is read as spaced-out words too."""
        raw = (text or "").lower().split()
        return sorted({w for t in set(raw) for w in self.words(t)} | self.runs(raw))

    def runs(self, raw: list[str]) -> set[str]:
        """The words of runs of four or more single signs."""
        out: set[str] = set()
        sizes = list(map(len, raw))
        if sizes.count(1) >= 4:
            run: list[str] = []
            for t, size in zip([*raw, "  "], [*sizes, 2], strict=True):
                if size == 1:
                    run.append(t)
                    continue
                if len(run) >= 4:
                    out.update(squeeze(w) for w in self.spaced("".join(run)))
                run = []
        return out


def squeeze(w: str) -> str:
    return _RUN.sub(r"\1", w)


def features_of(word: str) -> list[str]:
    """The word and its prefixes of 4 to 7 letters."""
    return ["=" + word, *(word[:k] + "~" for k in range(4, 8) if len(word) > k)]


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of letter trigrams over all texts; one row per trigram leaves each task and reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_N**3, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    u = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                    x = np.concatenate(([0, 0], np.where(u < 0x250, _LUT[np.minimum(u, 0x24F)], 1), [0]))
                    x = np.concatenate(([0], x[1:][(x[1:] != 0) | (x[:-1] != 0)]))  # one boundary between words
                    total += np.bincount((x[:-2] * _N + x[1:-1]) * _N + x[2:], minlength=_N**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_N**3, np.int64)
    out[rows["gram"].to_numpy(int)] = rows["n"]
    return out


def name_of(text: str | None) -> int:
    """A name that near copies share and unlike texts do not: two minima over a text's runs of five words, together."""
    w = (text or "").lower().split()
    runs = [zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4))]
    return min(runs) << 31 | min(h * 2654435761 % 2**32 for h in runs) >> 1


def choose(support: dict[str, int], clean: dict[str, int], base: float, candidates: int | None = None) -> list[str]:
    """Features that chance does not explain, best first, without those whose words chosen ones mark already.

    A prefix fires on longer words only.  A feature under a chosen prefix adds no word to it; a prefix over
    chosen features must hold with the support that those leave.

    ``support`` counts distinct toxic texts, ``clean`` distinct clean ones; a feature that has ``n`` of the first
    and none of the second would come by chance with ``base ** n``, which must be below one in a hundred over all
    ``candidates`` (those of ``support``, if not given).  Every clean text takes five nats away.
    """
    gain = {f: n * np.log(1 / base) - 5 * clean.get(f, 0) for f, n in support.items()}
    need = np.log(100 * max(1, len(gain) if candidates is None else candidates))
    out: list[str] = []
    prefixes: set[str] = set()
    told: Counter[str] = Counter()  # support of chosen features, by the prefixes over them
    for f in sorted((f for f, g in gain.items() if g >= need), key=lambda f: (-gain[f], len(f), f)):
        whole, stem = f[0] == "=", f.strip("=~")
        over = [stem[:k] for k in range(4, min(8, len(stem)))]
        left = 0 if whole else told[stem]
        if prefixes.isdisjoint(over) and gain[f] - left * np.log(1 / base) >= need:
            out.append(f)
            told.update(dict.fromkeys(over, support[f] - left))
            if not whole:
                prefixes.add(stem)
    return out


def train(docs: DataFrame, labels: DataFrame, channel, id_col: str, text_col: str, label: str, max_rows: int) -> dict[str, float]:
    """Chosen features with the log-odds of label 1 that each one carries alone."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(of=[name_of(t) for t in pdf["text"]])

    rows = durable(training_rows(docs, labels, id_col, text_col, label, max_rows).mapInPandas(named, "text string, label int, of long"))

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            feature, of = [], []
            for t, name in zip(pdf["text"], pdf["of"], strict=True):
                own = {f for w in channel.value.restore(t) for f in features_of(w) if wanted is None or f in wanted}
                feature += own
                of += [name] * len(own)
                if len(feature) >= _GIVEN:
                    yield pd.DataFrame({"feature": pd.Series(feature, dtype=object), "of": np.array(of, np.int64)})
                    feature, of = [], []
            yield pd.DataFrame({"feature": pd.Series(feature, dtype=object), "of": np.array(of, np.int64)})

    wanted = None
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.countDistinct("of").alias("n")).collect()}
    toxic, clean = sum(v for k, v in n.items() if k > 0), sum(v for k, v in n.items() if k <= 0)
    if not toxic:
        return {}
    base = min(0.5, max(1e-4, toxic / (toxic + clean)))
    found = durable(rows.where("label > 0").select("text", "of").mapInPandas(marks, "feature string, of long").groupBy("feature").agg(F.countDistinct("of").alias("n")).where("n > 2"))
    candidates = found.count()
    # the others cannot be chosen, with however few clean texts
    support = wanted = {r.feature: r.n for r in found.where(F.col("n") >= float(np.log(100 * max(1, candidates)) / np.log(1 / base)) - 1e-6).collect()}
    also = rows.where("label <= 0").select("text", "of").mapInPandas(marks, "feature string, of long").groupBy("feature").agg(F.countDistinct("of").alias("n"))
    in_clean = {r.feature: r.n for r in also.collect()}
    return {f: float(np.log((support[f] + 0.5) / (in_clean.get(f, 0) + 0.5))) for f in choose(support, in_clean, base, candidates)}


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.5, max_rows: int = 12_000, row_col: str | None = None) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted, marks`` (restored words that count for label 1), and the long ``row_col`` as it came if named."""
    spark = docs.sparkSession
    channel = spark.sparkContext.broadcast(Channel(trigram_counts(docs, text_col)))
    model = spark.sparkContext.broadcast(train(docs, labels, channel, id_col, text_col, label, max_rows))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds, decoder = model.value, channel.value
        seen, marked = decoder.seen, decoder.marked

        def strongest(words) -> dict[str, str]:
            best = ((w, max((f for f in features_of(w) if f in odds), key=lambda f: (odds[f], f), default=None)) for w in words)
            return {w: f for w, f in best if f}

        for pdf in batches:
            scores, marks = [], []
            for t in pdf["text"]:
                raw = (t or "").lower().split()
                tokens, found = set(raw), {}
                new = tokens - seen
                if len(seen) + len(new) > _KEPT:
                    seen.clear()
                    marked.clear()
                    new = tokens
                for token in new:
                    own = strongest(decoder._words(token))
                    if len(token) > _REMEMBERED:
                        found |= own
                    else:
                        seen.add(token)
                        if own:
                            marked[token] = own
                for token in tokens & marked.keys():
                    found |= marked[token]
                found |= strongest(decoder.runs(raw))
                hit, words = set(found.values()), sorted(found)  # a word counts once, by its strongest feature
                # noisy or: each feature alone leaves the text clean with the probability of its odds
                none = np.log1p(-NO_MARK) - sum(np.log1p(np.exp(odds[f])) for f in sorted(hit))
                scores.append(-np.expm1(none) if odds else 0.0)
                marks.append(words)
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "score": np.array(scores, float), "marks": pd.Series(marks, dtype=object)} | ({"row": pdf["row"]} if row_col else {}))

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (fold(F.col(id_col)) == 0).alias("held_out"), *([F.col(row_col).alias("row")] if row_col else []))
    out = out.mapInPandas(score, "id long, held_out boolean, score double, marks array<string>" + (", row long" if row_col else ""))
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "marks", *([F.col("row").alias(row_col)] if row_col else []))
