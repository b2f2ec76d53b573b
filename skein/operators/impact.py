"""Impact of lines and diffs, kinds of change, and stack traces mapped onto symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import frame, suffixes
from .intervals import stab

#: Kinds of change, strongest first.
CHANGES = ("contract_key", "annotation", "signature", "type", "declaration", "body")
TYPES = ("class", "interface", "enum", "struct", "trait", "type_alias", "annotation")
CALLABLE = ("function", "method", "constructor")
VALUES = ("property", "field", "parameter", "variable", "constant", "enum_member")


def innermost(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lines(path, line, ..)`` with ``node`` and ``node_kind`` of the smallest span that holds each, the later start on ties."""
    n = nodes.select(F.col("file_path").alias("path"), F.col("id").alias("node"), F.col("kind").alias("node_kind"), "start_line", "end_line")
    hits = stab(lines.select("path", "line").distinct(), n, ["path"], "line", "start_line", "end_line")
    best = F.min(F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), "node", "node_kind"))
    held = hits.groupBy("path", "line").agg(best.alias("x")).select("path", "line", "x.node", "x.node_kind")
    return lines.join(held, ["path", "line"], "left").select(*lines.columns, "node", "node_kind")


def classify(lines: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``lines(path, line)`` with ``change``: the strongest thing anchored on the line.

    A contract edge makes it a contract key, a DECORATES edge an annotation; a callable that starts there a signature, a type a type,
    a value a declaration; all else is body.  ``edges`` needs ``file_path, line, kind``.
    """
    e = edges.where(F.col("kind").isin("EXPOSES", "CONSUMES", "DECORATES")).groupBy(F.col("file_path").alias("path"), "line")
    e = e.agg(F.max(F.col("kind").isin("EXPOSES", "CONSUMES")).alias("contract"), F.max(F.col("kind") == "DECORATES").alias("annotation"))
    n = nodes.groupBy(F.col("file_path").alias("path"), F.col("start_line").alias("line"))
    n = n.agg(*[F.max(F.col("kind").isin(*k)).alias(c) for c, k in (("callable", CALLABLE), ("type", TYPES), ("value", VALUES))])
    j = lines.select("path", "line").distinct().join(e, ["path", "line"], "left").join(n, ["path", "line"], "left")
    out = F.lit(CHANGES[-1])
    for change, mark in reversed(tuple(zip(CHANGES, ("contract", "annotation", "callable", "type", "value"), strict=False))):
        out = F.when(F.col(mark), change).otherwise(out)
    return j.select("path", "line", out.alias("change"))


def retarget(lines: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``lines(path, line)`` with ``change`` and ``target``: the innermost symbol, or the source of a contract edge on the line."""
    modules = nodes.where("kind in ('module', 'file')").select(F.col("id").alias("src"))
    c = edges.where("kind in ('EXPOSES', 'CONSUMES')").join(modules, "src", "left_anti").groupBy(F.col("file_path").alias("path"), "line").agg(F.min("src").alias("contract_src"))
    j = innermost(lines.select("path", "line").distinct(), nodes).join(c, ["path", "line"], "left").join(classify(lines, nodes, edges), ["path", "line"])
    return j.select("path", "line", "change", F.coalesce("contract_src", "node").alias("target"))


def diff_lines(diffs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Added lines ``(id_col, path, line, text)`` of unified diffs, numbered as in the new file.

    A hunk header sets the number, added and context lines move it.  Rows are numbered inside their diff; nothing but the diffs' own
    lines is sorted.
    """
    rows = diffs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\r?\n", -1)).alias("row", "t"))
    w = W.partitionBy(id_col).orderBy("row")
    path = F.regexp_extract("t", r"^\+\+\+ (?:b/)?([^\t]+)", 1)
    rows = rows.withColumn("head", F.col("t").startswith("+++ ") & (F.lag("t").over(w).startswith("--- ")))
    rows = rows.withColumn("path", F.last(F.when(F.col("head"), path), True).over(w))
    start = F.regexp_extract("t", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    rows = rows.withColumn("hunk", F.last(F.when(start != "", F.struct("row", start.cast("int").alias("start"))), True).over(w))
    inside = F.col("hunk").isNotNull() & (F.col("row") > F.col("hunk.row"))
    moves = (inside & F.col("t").rlike(r"^[ +]") & ~F.col("head")) | (inside & (F.col("t") == ""))
    rows = rows.withColumn("moved", F.sum(moves.cast("int")).over(w.partitionBy(id_col, "hunk.row").rowsBetween(W.unboundedPreceding, -1)))
    added = rows.where(inside & F.col("t").startswith("+") & ~F.col("head") & (F.col("path") != "/dev/null"))
    return added.select(id_col, "path", (F.col("hunk.start") + F.coalesce("moved", F.lit(0))).cast("int").alias("line"), F.substring("t", F.lit(2), F.length("t")).alias("text"))


def frames(traces: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct frames ``(id_col, at, path, line)`` of stack traces, the innermost call first.

    Python prints the innermost call last, so such traces are turned round.
    """
    rows = traces.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("row", "t")).withColumn("f", frame(F.col("t"))).where("f is not null")
    rows = rows.withColumn("python", F.col("t").rlike(r'^\s*File "[^"]+", line \d+'))
    turned = rows.groupBy(id_col).agg(F.max("python").alias("turned"))
    rows = rows.join(turned, id_col).withColumn("key", F.when(F.col("turned"), -F.col("row")).otherwise(F.col("row")))
    rows = rows.groupBy(id_col, "f").agg(F.min("key").alias("key"))
    at = F.row_number().over(W.partitionBy(id_col).orderBy("key")) - 1
    return rows.select(id_col, at.alias("at"), "f.path", "f.line")


def match_files(wanted: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """``wanted(path)`` to ``(path, file, is_exact)``: the file itself, or else the shortest ``most`` paths that end with its name.

    A path meets the files that it may be by its suffixes, and for the others the first ``most`` files of each name are
    kept beforehand, so that the paths and files of a common name (``index.js``) are never paired.
    """
    base = lambda c: F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    w = wanted.select("path").distinct()
    f = files.select(F.col("path").alias("file")).where("file is not null").distinct()
    same = w.withColumn("file", F.explode(suffixes(F.col("path"), "/"))).join(f, "file")
    same = same.groupBy("path").agg(F.min(F.struct(F.length("file").alias("n"), "file"))["file"].alias("file"))
    nth = F.row_number().over(W.partitionBy("base").orderBy(F.length("file"), "file"))
    first = f.withColumn("base", base(F.col("file"))).withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    rest = w.join(same.select("path"), "path", "left_anti").withColumn("base", base(F.col("path"))).join(first, "base")
    return same.select("path", "file", F.lit(True).alias("is_exact")).union(rest.select("path", "file", F.lit(False)))


def map_stacktrace(traces: DataFrame, id_col: str, text_col: str, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id_col, at, path, line, file, node, missing)``: frames with the symbol that holds their line; a frame outside the project is ``missing``."""
    fr = frames(traces, id_col, text_col)
    j = fr.join(match_files(fr, files).select("path", "file"), "path", "left")
    here = innermost(j.where("file is not null").select(F.col("file").alias("path"), "line").distinct(), nodes).select(F.col("path").alias("file"), "line", "node")
    out = j.join(here, ["file", "line"], "left")
    return out.select(id_col, "at", "path", "line", "file", "node", F.col("node").isNull().alias("missing"))


def changed(c: Column) -> Column:
    """Rank of a kind of change, strongest 0."""
    return F.array_position(F.array(*map(F.lit, CHANGES)), c) - 1
