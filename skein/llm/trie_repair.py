"""Repair of conversation structure: cheapest edits to ``system? (user assistant)+``, by layers of a DP that prefixes share.

Each conversation becomes a signature, one sign a row: the role's initial (``s``, ``u``, ``a``, else ``x``; upper case
where the text is truncated) or ``-`` where the row must go (blank, duplicate).  The distinct signatures, sorted, are
inserted into a prefix trie: it is walked depth first, a node's DP layer (the least cost of each state of the role
automaton) is computed once for all signatures below it, and only the layers of the current path are held.  A
signature's end answers by walking its path back over the layers.  Answers go back to the conversations by signature.

A row's first fault counts: blank (no character outside ``[\\x20\\x09-\\x0D]``), duplicate (role and text came earlier),
truncated (its last such character is none of ``.!?``).  Edits: K keep (0), R rerole to user or assistant (3), D delete
(4; the only edit of blank and duplicate rows), I insert an empty user or assistant row anywhere (3).  A truncated row
that stays adds 3.  Of the cheapest edits the ASCII-least string of initials is taken.

Defined edge cases: nulls in role and text read as one space (so such a text is blank and such a role none of
the three); null ids form one conversation; null turns come first; ties in turn are ordered by role, then by the MD5 of the
text; equal rows are duplicates from the second on; a conversation without rows left has zeros, an empty audit and
the hash of an empty string; an empty table gives an empty result; extra columns are ignored.  Rows of one conversation meet in
one task, since its hash and its audit are sequential, but they pass it in sorted order, which spills to disk: besides a batch,
the task holds one sign a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_FAR = 1 << 60
_ROLE = {"u": "user", "a": "assistant"}
#: States of the role automaton: nothing yet, after system, after user, after assistant.  An answer ends in the first or the last.
_ENDS = (0, 3)
#: Moves of the automaton: sign, from, to.
_MOVES = (("s", 0, 1), ("u", 0, 2), ("u", 1, 2), ("u", 3, 2), ("a", 2, 3))
#: Moves that make a user or an assistant row: those of Rerole and Insert.
_MADE = tuple((p, q) for c, p, q in _MOVES if c != "s")


def _inserted(layer: list[int]) -> list[int]:
    """The layer when empty rows may be inserted after it."""
    f0, f1, f2, f3 = layer
    f2 = min(f2, f0 + INSERT, f1 + INSERT, f3 + INSERT)
    return [f0, f1, f2, min(f3, f2 + INSERT)]


def row_moves(sign: str) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) of all edits of a row."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if sign != "-":
        more = TRUNCATED if sign.isupper() else 0
        out += [("K", p, q, KEEP + more) for c, p, q in _MOVES if c == sign.lower()]
        out += [("R", p, q, REROLE + more) for p, q in _MADE]
    return out


MOVES = {sign: row_moves(sign) for sign in "-suaxSUAX"}


class Trie:
    """Walk of the prefix trie of sorted signatures; ``layers[i]`` belongs to the first ``i`` signs of the current path."""

    def __init__(self):
        self.path, self.layers, self.computed = "", [_inserted([0, _FAR, _FAR, _FAR])], 0

    def go(self, signature: str) -> None:
        """Leave the branches that end before ``signature`` and compute the layers that it does not share."""
        n = 0
        for a, b in zip(self.path, signature, strict=False):
            if a != b:
                break
            n += 1
        del self.layers[n + 1 :]
        for sign in signature[n:]:
            old, new = self.layers[-1], [_FAR] * 4
            for _, p, q, cost in MOVES[sign]:
                if old[p] + cost < new[q]:
                    new[q] = old[p] + cost
            self.layers.append(_inserted(new))
            self.computed += 1
        self.path = signature

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and ASCII-least cheapest edits of the signature that the walk stands at."""
        layers, n = self.layers, len(signature)
        best = min(layers[n][q] for q in _ENDS)
        # states of each layer that lie on a cheapest way
        on = [[False] * 4 for _ in range(n + 1)]
        for q in _ENDS:
            on[n][q] = layers[n][q] == best
        for i in range(n, -1, -1):
            f, here = layers[i], on[i]
            for p, q in ((2, 3), (0, 2), (1, 2), (3, 2)):
                if here[q] and f[p] + INSERT == f[q]:
                    here[p] = True
            if i:
                for _, p, q, cost in MOVES[signature[i - 1]]:
                    if here[q] and layers[i - 1][p] + cost == f[q]:
                        on[i - 1][p] = True
        edits, i, at = [], 0, {0}
        while not (i == n and any(q in at and layers[n][q] == best for q in _ENDS)):
            f, by = layers[i], {}
            if i < n:
                for edit, p, q, cost in MOVES[signature[i]]:
                    if p in at and on[i + 1][q] and f[p] + cost == layers[i + 1][q]:
                        by.setdefault(edit, set()).add(q)
            for p, q in _MADE:
                if p in at and on[i][q] and f[p] + INSERT == f[q]:
                    by.setdefault("I", set()).add(q)
            edit = min(by)
            edits.append(edit)
            at, i = by[edit], i + (edit != "I")
        return best, "".join(edits)


def answers(signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of sorted signatures."""
    trie = Trie()
    for s in signatures:
        trie.go(s)
        yield (s, *trie.answer(s))


# --------------------------------------------------------------------------- rows of a conversation

_TEXT = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
#: How rows of a conversation lie: after its header, by turn with nulls first, then by role and by hash of the text.
_ORDER = ("key", "body", "turn", "role", "hash")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by ``crc32('conv:turn') % 20``: 0 drops (``dropped``), 1 empties, 2 takes ``.!?`` away, 3 repeats, 4 makes it a user's."""
    how = F.crc32(F.concat(_TEXT(conv), F.lit(":"), _TEXT(turn)).cast("binary")) % 20
    said = F.when(how == 1, "").when(how == 2, F.regexp_replace(_TEXT(text), "[.!?]", "")).otherwise(_TEXT(text))
    new = {conv: F.col(conv), turn: F.col(turn), role: F.when(how == 4, "user").otherwise(_TEXT(role)), text: said, "dropped": how == 0}
    copies = F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(*[c.alias(n) for n, c in new.items()], F.explode(copies).alias("_copy")).drop("_copy")


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str, dropped: str | None) -> DataFrame:
    out = rows.select(F.col(conv).cast("string").alias("key"), F.col(turn).cast("long").alias("turn"), _TEXT(role).alias("role"), _TEXT(text).alias("text"), (F.col(dropped) if dropped else F.lit(False)).alias("dropped"))
    return out.withColumn("hash", F.unhex(F.md5("text")))


_FOLDED = "key string, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batches(rows: Iterable[tuple], ddl: str, most: int = 1024, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples to record batches of bounded length and size."""
    held, size, schema = [], 0, _schema(ddl)
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= most_chars:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


_NONE = object()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, dropped, turn, initial, blank, again, open) to one row a conversation."""

    def run() -> Iterator[tuple]:
        at, signs = _NONE, bytearray()
        low = high = last = before = None
        turns = blank = again_ = open_ = illegal = 0
        for key, dropped, turn, initial, empty, again, unfinished in _rows(batches):
            if key != at:
                if at is not _NONE:
                    yield at, signs.decode(), high - low + 1 - turns if turns else 0, blank, again_, open_, illegal
                at, signs = key, bytearray()
                low = high = last = before = None
                turns = blank = again_ = open_ = illegal = 0
            if dropped:
                continue
            if turn is not None:
                low, high = turn if low is None else low, turn
                turns, last = turns + (turn != last), turn
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            if empty or again:
                blank, again_ = blank + empty, again_ + (not empty)
                signs += b"-"
            else:
                open_ += unfinished
                sign = initial if initial in ("s", "u", "a") else "x"
                signs += (sign.upper() if unfinished else sign).encode()
        if at is not _NONE:
            yield at, signs.decode(), high - low + 1 - turns if turns else 0, blank, again_, open_, illegal

    return _batches(run(), _FOLDED)


def signatures(rows: DataFrame) -> DataFrame:
    """One row a conversation with its signature and counts of faults; texts stay where they are."""
    last = F.right(F.expr(r"trim(TRAILING ' \t\n\u000B\u000C\r' FROM text)"), F.lit(1))
    narrow = rows.select("key", "dropped", "turn", "role", "hash", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    narrow = narrow.repartition("key")  # both orders below find a conversation's rows in one task
    nth = F.row_number().over(Window.partitionBy("key", "dropped", "role", "hash").orderBy("turn"))
    narrow = narrow.withColumn("again", nth > 1).sortWithinPartitions("key", "dropped", "turn", "role", "hash", "again")
    return narrow.select("key", "dropped", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "again", "open").mapInArrow(_fold, _FOLDED)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(answers(s for (s,) in _rows(batches)), "signature string, cost long, audit string")


def decisions(folded: DataFrame) -> DataFrame:
    """Cost and audit of every distinct signature: sorted ranges of them, each walked as one trie."""
    distinct = folded.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_decide, "signature string, cost long, audit string")


_HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_DONE = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, position long, edit string, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers, each with its conversation's rows after it, to headers (position 0) and repaired rows."""

    def run() -> Iterator[tuple]:
        key, left, state, place = None, iter(()), 0, 0
        step = {(p, c): q for c, p, q in _MOVES}
        none = (None,) * len(_HEAD)

        def put(edit: str, role: str, text: str) -> tuple:
            nonlocal place
            place += 1
            return (key, *none, place, edit, role, text)

        def made() -> str:
            nonlocal state
            c = "a" if state == 2 else "u"
            state = step[state, c]
            return _ROLE[c]

        for k, body, role, text, *head in _rows(batches):
            if not body:
                for _ in left:  # what the conversation before still lacks
                    yield put("I", made(), "")
                key, left, state, place = k, iter(head[-1]), 0, 0
                yield (key, *head, 0, None, None, None)
                continue
            for edit in left:
                if edit != "I":
                    break
                yield put("I", made(), "")
            if edit == "K":
                state = step[state, role[:1]]
                yield put(edit, role, text)
            elif edit == "R":
                yield put(edit, made(), text)
        for _ in left:
            yield put("I", made(), "")

    return _batches(run(), _DONE)


def _repair(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    folded = durable(signatures(rows))
    heads = folded.join(decisions(folded), "signature").select("key", F.lit(False).alias("body"), *_HEAD)
    bodies = rows.where("not dropped").select("key", F.lit(True).alias("body"), "turn", "role", "hash", "text")
    both = bodies.unionByName(heads, allowMissingColumns=True).repartition("key").sortWithinPartitions(*_ORDER)
    return both.select("key", "body", "role", "text", *_HEAD).mapInArrow(_apply, _DONE)


def _typed(rows: DataFrame, conv: str) -> Column:
    return F.col("key").cast(rows.schema[conv].dataType).alias(conv)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None) -> DataFrame:
    """The repaired rows ``(conv, position from 1, edit, role, text)``; rows marked in the column ``dropped`` are not there."""
    return _repair(_plain(rows, conv, turn, role, text, dropped)).where("position > 0").select(_typed(rows, conv), "position", "edit", F.col("role").alias(role), F.col("text").alias(text))


_DIGEST = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers and repaired rows to headers with the hash of ``role:text`` joined by newlines."""

    def run() -> Iterator[tuple]:
        head, sha = None, None
        for key, *rest in _rows(batches):
            *own, position, _, role, text = rest
            if position == 0:
                if head:
                    yield (*head, sha.hexdigest())
                head, sha = (key, *own), hashlib.sha256()
            else:
                sha.update(f"{chr(10) if position > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if head:
            yield (*head, sha.hexdigest())

    return _batches(run(), _DIGEST)


def audit(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None) -> DataFrame:
    """One row a conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    done = _repair(_plain(rows, conv, turn, role, text, dropped)).mapInArrow(_digest, _DIGEST)
    return done.select(_typed(rows, conv), *_HEAD, "repaired_sha256")
