"""A project's own adapters and risk rules, from TOML files that lie in a folder: parsed, checked entry by entry, digested.

An entry that is not well formed is refused with its file, its number and the reason, and the others of the file stay.

    [[adapter]]
    id = "acme.route"
    lang = ["python"]
    match = "decorator"            # call, decorator or annotation
    names = ["acme.expose"]
    methods = ["get"]              # optional
    contract = { kind = "http_route", role = "exposes", key_arg = 0, key_name = "path" }

    [[rule]]
    id = "blocking"
    lang = "python"
    severity = 2
    targets = ["acme.wait"]
    allowed = ["acme.sleep"]       # optional
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.contracts import ADAPTERS
from ..operators.risks import RULES

MATCH = {"call": "call", "decorator": "decorate", "annotation": "decorate"}
ROLES, TOP = ("exposes", "consumes"), 3
_ADAPTER = ADAPTERS.split(", ", 1)[1]
PACK = f"file string, entry int, nth int, sort string, refused string, {_ADAPTER}, {RULES.replace('lang string', 'rule_lang string')}"


class Refused(ValueError):
    """An entry of a pack that says something else than it must."""


def _texts(entry: dict, key: str, empty: bool = False) -> list[str]:
    value = entry.get(key, [])
    out = [value] if isinstance(value, str) else value
    if not isinstance(out, list) or not all(isinstance(x, str) and x for x in out) or not (out or empty):
        raise Refused(f"{key} must be texts")
    return out


def adapter_rows(entry: dict) -> list[dict]:
    contract = entry.get("contract")
    if not isinstance(contract, dict) or not isinstance(contract.get("kind"), str):
        raise Refused("contract needs a kind")
    if contract.get("role") not in ROLES:
        raise Refused(f"role {contract.get('role')!r}")
    if entry.get("match") not in MATCH:
        raise Refused(f"match {entry.get('match')!r}")
    arg, name = contract.get("key_arg", 0), contract.get("key_name")
    if isinstance(arg, bool) or not isinstance(arg, int) or arg < 0 or not isinstance(name, str | None):
        raise Refused("key_arg must be a place, key_name a text")
    (own,) = _texts(entry, "id")[:1]
    same = {"adapter": own, "ref_kind": MATCH[entry["match"]], "contract_kind": contract["kind"], "role": contract["role"], "arg": arg, "arg_name": name}
    return [same | {"lang": lang, "name": n, "method": m} for lang in _texts(entry, "lang") for n in _texts(entry, "names") for m in _texts(entry, "methods", True) or [None]]


def rule_rows(entry: dict) -> list[dict]:
    base = entry.get("severity")
    if isinstance(base, bool) or not isinstance(base, int) or not 0 <= base <= TOP:
        raise Refused(f"severity {base!r}")
    (own,) = _texts(entry, "id")[:1]
    return [{"rule": own, "rule_lang": lang, "base": base, "target": t, "allowed": ok} for lang in _texts(entry, "lang") for ok, key in ((False, "targets"), (True, "allowed")) for t in _texts(entry, key, ok)]


def rows_of(file: str, content: bytes) -> list[dict]:
    """Rows of ``PACK`` of a file."""
    try:
        pack = tomllib.loads(content.decode())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        return [{"file": file, "entry": 0, "sort": "refused", "refused": str(e)}]
    out = [{"file": file, "entry": 0, "sort": "refused", "refused": f"unknown table {k!r}"} for k in pack if k not in ("adapter", "rule")]
    for sort, read in (("adapter", adapter_rows), ("rule", rule_rows)):
        entries = pack.get(sort, [])
        for k, entry in enumerate(entries if isinstance(entries, list) else [entries], 1):
            try:
                if not isinstance(entry, dict):
                    raise Refused("no table")
                out += [{"file": file, "entry": k, "nth": i, "sort": sort} | r for i, r in enumerate(read(entry))]
            except Refused as e:
                out.append({"file": file, "entry": k, "sort": "refused", "refused": f"{sort}: {e}"})
    return out


def packs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``PACK`` from the ``.toml`` files under ``path``, which are some files of a project."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PACK.split(", ")]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(rows_of(file, bytes(content)), columns=columns, dtype=object)
                yield out.where(out.notna(), None)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.toml").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.substring_index("path", "/", -1).alias("path"), "content").mapInPandas(run, PACK)


def adapters(pack: DataFrame, after: int) -> DataFrame:
    """The adapters of a pack in load order, numbered from ``after`` on."""
    nth = F.row_number().over(W.orderBy("file", "entry", "nth")) + after - 1  # a project's adapters, some hundred rows
    return pack.where("sort = 'adapter'").withColumn("nth", nth.cast("int")).select(*[c.split()[0] for c in ADAPTERS.split(", ")])


def rules(pack: DataFrame) -> DataFrame:
    return pack.where("sort = 'rule'").select("rule", F.col("rule_lang").alias("lang"), "base", "target", "allowed")


def refused(pack: DataFrame) -> DataFrame:
    return pack.where("sort = 'refused'").select("file", "entry", "refused")
