"""Tokens of brace languages as rows, with brackets matched: what ``brace`` reads declarations and references from.

One pass per file over its bytes (read as Latin-1, so that positions are byte offsets).  Each row says which bracket the token
lies in (``up``), the brackets around that one (``around``, outermost first), and for an opening bracket its partner and
its arguments.  Everything else is done on the rows by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Languages whose blocks are braces; of the others only some tokens mean the same.
BRACES = ("java", "typescript", "javascript")
_WORD = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_MASTER = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?\*/|\s+)"
    r"|(?P<string>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    rf"|(?P<word>{_WORD})"
    r"|(?P<number>\d[\w.]*)"
    r"|(?P<sign>\.\.\.|=>|->|::|\?\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|.)",
    re.DOTALL | re.ASCII,
)
#: What a regular expression literal may follow.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || return typeof case".split())
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
TOKENS = (
    "file_path string, i int, kind string, text string, a int, b int, line int, end_line int, up int, pair int, around array<int>, args array<struct<index:int,name:string,text:string>>"
)


def scan(source: str, regexes: bool) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) of every token but blanks and comments."""
    at, last = 0, "("
    while at < len(source):
        m = None
        if regexes and source[at] == "/" and last in _BEFORE_REGEX:
            m = _REGEX.match(source, at)
            kind = "string"
        if m is None:
            m = _MASTER.match(source, at)
            kind = m.lastgroup
        if kind != "skip":
            last = m[0]
            yield kind, last, at, m.end()
        at = m.end()


def rows_of(path: str, lang: str, content: bytes) -> tuple[list[dict], str | None]:
    """Token rows of a file, and what is wrong with its brackets if anything is."""
    source = content.decode("latin-1")
    starts = np.flatnonzero(np.frombuffer(content, np.uint8) == 10) + 1  # where lines begin, but for the first
    found = list(scan(source, lang != "java"))
    lines = np.searchsorted(starts, [[t[2], max(t[2], t[3] - 1)] for t in found], "right") + 1 if found else []
    text = lambda a, b: source[a:b].encode("latin-1").decode("utf-8", "replace")
    rows: list[dict] = []
    open_: list[int] = []
    commas: list[list[int]] = []
    wrong = None
    for i, ((kind, said, a, b), (line, end)) in enumerate(zip(found, lines, strict=True)):
        if said in (")", "]", "}") and kind == "sign":
            if not open_ or _PAIRS[rows[open_[-1]]["text"]] != said:
                wrong = wrong or f"line {line}: {said} closes nothing"
                break
            o, cuts = open_.pop(), commas.pop()
            rows[o]["pair"], rows[o]["end_line"] = i, int(end)
            if rows[o]["text"] == "(" and i > o + 1:
                ends = [*cuts, i]
                begins = [o + 1, *(c + 1 for c in cuts)]
                parts = [(found[x][2], found[y - 1][3]) for x, y in zip(begins, ends, strict=True) if y > x]
                rows[o]["args"] = [{"index": k, "name": None, "text": text(x, y)} for k, (x, y) in enumerate(parts)]
        elif said == "," and kind == "sign" and open_:
            commas[-1].append(i)
        shown = said if kind in ("sign", "number") else text(a, b)
        rows.append({"file_path": path, "i": i, "kind": kind, "text": shown, "a": a, "b": b, "line": int(line), "end_line": int(end), "up": open_[-1] if open_ else -1, "pair": None, "around": list(open_) if said in _PAIRS else None, "args": None})
        if said in _PAIRS and kind == "sign":
            open_.append(i)
            commas.append([])
    if open_ and wrong is None:
        wrong = f"line {rows[open_[-1]]['line']}: {rows[open_[-1]]['text']} stays open"
    return rows, wrong


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in TOKENS.split(", ")]
    for pdf in batches:
        for path, lang, content in zip(pdf["path"], pdf["lang"], pdf["content"], strict=True):
            rows, wrong = rows_of(path, lang, bytes(content))
            if wrong:
                rows = [{"file_path": path, "i": -1, "kind": "error", "text": wrong, "line": int(re.search(r"\d+", wrong)[0])}]
            for k in range(0, len(rows), 20_000):
                out = pd.DataFrame(rows[k : k + 20_000], columns=columns, dtype=object)
                yield out.where(out.notna(), None)


def tokens(ledger: DataFrame) -> DataFrame:
    """Rows of ``TOKENS`` for every readable file of a brace language; a file whose brackets do not match gives one row of kind ``error``."""
    return ledger.where("content is not null").select("path", "lang", "content").mapInPandas(_tokens, TOKENS)
