"""Source trees as DataFrames: files with dialect and skip reason, and Python symbols and references read with ``ast``.

Files are read by Spark's binaryFile source; one Arrow pass parses each readable Python file and
returns nodes, references and usage sites as rows of one table, told apart by ``rec``.  Java, TypeScript and JavaScript are read
from tokens (``brace``) into the same table.  Other dialects have no grammar here and are kept in the file ledger as ``missing_grammar``.
"""

from __future__ import annotations

import ast
import hashlib
import logging
import re
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

MAX_BYTES, NUL_WINDOW = 2_000_000, 8192
IGNORED = ("node_modules", "__pycache__", "venv", "build", "dist", "target")
DIALECTS = {"py": "python", "pyi": "python", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "scala": "scala",
            "mjs": "javascript", "cjs": "javascript", "mts": "typescript", "cts": "typescript", "kts": "kotlin", "rake": "ruby", "sh": "bash", "bash": "bash"}
SHEBANGS = (("python", r"^#!.*\bpython"), ("bash", r"^#!.*\b(?:ba|z|k)?sh\b"), ("javascript", r"^#!.*\bnode\b"), ("ruby", r"^#!.*\bruby\b"))
GENERATED = r"(?i)(?:@generated|do not edit|code generated by|autogenerated)"
#: Files whose text names a service; kept in the ledger though no dialect reads them.
MANIFEST = r"^(?:pom\.xml|package\.json|pyproject\.toml|go\.mod|Cargo\.toml)$"
#: What stands before the first slash of a path.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)"
RAW = (
    "rec string, file_path string, id string, kind string, name string, qualified_name string, dotted string, signature string, docstring string, flags int, parent_id string,"
    " start_line int, end_line int, from_node string, ref_text string, target string, receiver string, lang string, type_ref string, position int, start_byte int, end_byte int,"
    " args array<struct<index:int,name:string,text:string>>, context_before string, context_line string, context_after string"
)


def _hidden(parts: list[str]) -> bool:
    return any(p.startswith(".") or p in IGNORED for p in parts)


def _odd(root: str) -> list[tuple[str, datetime, int]]:
    """(uri, time, size) of the files that Spark's file source does not show: names that begin with ``_``, such as ``__init__.py``, and empty ones."""
    try:
        at, base = fs.FileSystem.from_uri(root if re.match(r"[A-Za-z][\w+.-]*:", root) else f"file://{root}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        logging.getLogger(__name__).warning("%s: empty files and names that begin with _ cannot be listed there", root)
        return []
    lead = re.match(r"^(?:[A-Za-z][\w+.-]*:)?", root)[0] or "file:"
    out = []
    for x in at.get_file_info(fs.FileSelector(base, recursive=True)):
        if x.type == fs.FileType.File and (x.base_name.startswith("_") or x.size == 0) and not _hidden(x.path[len(base) :].strip("/").split("/")):
            out.append((f"{lead}{'' if x.path.startswith('/') else '//'}{x.path}", x.mtime.replace(tzinfo=None), x.size))
    return out


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        content = []
        for path, size in zip(pdf["path"], pdf["length"], strict=True):
            at, name = fs.FileSystem.from_uri(path)
            content.append(at.open_input_stream(name).read() if 0 < size <= MAX_BYTES else b"" if size == 0 else None)
        yield pdf.assign(content=pd.Series(content, dtype=object))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of the files of a tree; ignored folders are left out and large files are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    every = raw.inputFiles()
    base = re.sub(_SCHEME, "", root).rstrip("/") + "/"
    mine = [x for x in every if not _hidden(re.sub(_SCHEME, "", unquote(x)).removeprefix(base).split("/"))]
    if len(mine) < len(every):
        raw = spark.read.format("binaryFile").option("__globPaths__", "false").load([unquote(x) for x in mine]) if mine else raw.limit(0)
    columns = ["path", "modificationTime", "length", "content"]
    there = raw.where(F.col("length") <= MAX_BYTES).select(columns).union(raw.where(F.col("length") > MAX_BYTES).select("path", "modificationTime", "length", F.lit(None).cast("binary")))
    odd = _odd(root)
    if not odd:
        return there
    rows = spark.createDataFrame(odd, "path string, modificationTime timestamp, length long").repartition(max(1, min(200, len(odd) // 64)))
    return there.union(rows.mapInPandas(_open, "path string, modificationTime timestamp, length long, content binary"))


def files(spark: SparkSession, root: str, service: str = "root") -> DataFrame:
    """The ledger of a tree: path, lang, size, hash, parse_status, skip_reason, and the content of files that are read."""
    return ledger(listing(spark, root), root, service)


def ledger(raw: DataFrame, root: str, service: str = "root") -> DataFrame:
    """Files by their path below ``root``, a prefix of each path; hidden ones and those of ignored folders are left out."""
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    plain = F.regexp_replace("path", _SCHEME, "")
    rel = F.when(plain.startswith(base), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)
    hidden = F.exists(F.split("rel", "/"), lambda p: p.startswith(".") | p.isin(*IGNORED))
    raw = raw.withColumn("rel", rel).where(~hidden)
    table = F.create_map(*[F.lit(x) for kv in DIALECTS.items() for x in kv])
    small = F.col("length") <= MAX_BYTES
    head = F.decode(F.substring(F.when(small, F.col("content")), 1, NUL_WINDOW), "iso-8859-1")
    by_ext = F.try_element_at(table, F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)))
    lang = F.coalesce(by_ext, *[F.when(F.substring(head, 1, 128).rlike(p), F.lit(k)) for k, p in SHEBANGS])
    skip = F.when(F.col("lang").isNull(), "unknown_dialect").when(~small, "too_large").when(F.instr(head, "\0") > 0, "binary").when(F.substring(head, 1, 512).rlike(GENERATED), "generated").when(~F.col("lang").isin("python", *tokens.BRACES), "missing_grammar")
    raw = raw.withColumn("lang", lang).withColumn("skip_reason", skip)
    return raw.select(F.col("rel").alias("path"), "lang", F.lit(service).alias("service_id"), F.when(small, F.sha2("content", 256)).alias("content_hash"), F.col("length").alias("size_bytes"), "skip_reason", F.when(F.col("skip_reason").isNull(), F.col("content")).alias("content"), F.when(small & F.substring_index("rel", "/", -1).rlike(MANIFEST), F.col("content").cast("string")).alias("manifest"))


def digest(*parts: str) -> str:
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def module_of(path: str) -> str:
    parts = path.rsplit(".", 1)[0].split("/")
    if parts[0] == "src" and len(parts) > 1:
        parts = parts[1:]
    if parts[-1] == "__init__" and len(parts) > 1:
        parts = parts[:-1]
    return "/".join(parts)


def dotted(e: ast.AST) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        left = dotted(e.value)
        return f"{left}.{e.attr}" if left else None
    return None


class Reader(ast.NodeVisitor):
    """Rows of one module: symbols with their containers, references with receiver, arguments and span in bytes."""

    def __init__(self, path: str, service: str, source: bytes = b""):
        self.path, self.service, self.module = path, service, module_of(path)
        self.rows: list[dict] = []
        self.stack: list[dict] = []
        self.imports: dict[str, str] = {}
        self.members: set[tuple[str, str]] = set()
        self.statement: ast.AST | None = None
        self.source, self.starts = source, [0]
        self.lines = source.decode("utf-8", "replace").splitlines()
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))

    def span(self, node: ast.AST) -> tuple[int, int]:
        """Bytes of a node; ``ast`` counts columns in UTF-8 bytes."""
        if not hasattr(node, "lineno") or node.end_lineno >= len(self.starts) + 1:
            return 0, len(self.source)
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def text(self, node: ast.AST) -> str:
        a, b = self.span(node)
        return self.source[a:b].decode("utf-8", "replace")

    def symbol(self, kind: str, name: str, node: ast.AST, signature: str = "", flags: int = 0, doc: str | None = None, end: int | None = None, type_ref: str | None = None, position: int | None = None) -> dict:
        members = [s["name"] for s in self.stack[1:]] + ([] if kind == "module" else [name])
        qname = f"{self.service}/python/{self.module}" + ("#" + "/".join(members) if members else "")
        a, b = self.span(node)
        row = {
            "rec": "node", "id": digest(self.service, "python", qname, signature), "kind": kind, "name": name, "qualified_name": qname, "signature": signature, "flags": flags, "docstring": doc,
            "dotted": ".".join([self.module.replace("/", "."), *members]), "parent_id": self.stack[-1]["id"] if self.stack else None, "lang": "python", "type_ref": type_ref, "position": position,
            "start_line": getattr(node, "lineno", 1), "end_line": end or getattr(node, "end_lineno", None) or 1, "start_byte": a, "end_byte": b,
        }
        self.rows.append(row)
        if row["parent_id"]:
            self.members.add((row["parent_id"], name))
        return row

    def ref(self, kind: str, text: str | None, node: ast.AST, target: str | None = None, args: list | None = None, whole: ast.AST | None = None) -> None:
        if not text:
            return
        head, _, rest = text.partition(".")
        receiver, _, name = text.rpartition(".")
        if target is None and head in self.imports:
            target = self.imports[head] + ("." + rest if rest else "")
        a, b = self.span(whole or node)
        self.rows.append({"rec": "ref", "kind": kind, "name": name, "ref_text": text, "target": target, "receiver": None if kind == "import" else receiver or None, "lang": "python", "from_node": self.stack[-1]["id"], "start_line": node.lineno, "end_line": node.end_lineno, "start_byte": a, "end_byte": b, "args": args or []})

    def arguments(self, call: ast.AST) -> list[dict]:
        if not isinstance(call, ast.Call):
            return []
        plain = [{"index": i, "name": None, "text": self.text(x)} for i, x in enumerate(call.args) if not isinstance(x, ast.Starred)]
        return plain + [{"index": len(call.args) + i, "name": k.arg, "text": self.text(k.value)} for i, k in enumerate(call.keywords) if k.arg]

    def usage(self, kind: str, name: str, node: ast.AST) -> None:
        near = [self.lines[i].strip() if 0 <= i < len(self.lines) else None for i in range(node.lineno - 2, node.lineno + 1)]
        self.rows.append({"rec": "usage", "kind": kind, "name": name, "from_node": self.stack[-1]["id"], "start_line": node.lineno, "end_line": node.end_lineno, "context_before": near[0], "context_line": near[1], "context_after": near[2]})

    def visit_Module(self, node: ast.Module) -> None:
        end = max((n.end_lineno for n in node.body), default=1)
        self.stack = [self.symbol("module", self.module.rsplit("/", 1)[-1], node, doc=ast.get_docstring(node), end=end)]
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.ref("import", a.name, node, a.name)
            self.usage("import", a.name, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        up = self.module.split("/")
        if not self.path.endswith("__init__.py"):
            up = up[:-1]
        base = up[: len(up) - node.level + 1] if node.level else []
        source = ".".join(base + ([node.module] if node.module else []))
        for a in node.names:
            full = f"{source}.{a.name}" if a.name != "*" and source else source or a.name
            if a.name != "*":
                self.imports[a.asname or a.name] = full
            self.ref("import", full, node, full)
            self.usage("import", full, node)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for x in node.decorator_list:
            self.ref("decorate", dotted(x.func if isinstance(x, ast.Call) else x), x, args=self.arguments(x))
        row = self.symbol("class", node.name, node, doc=ast.get_docstring(node))
        self.stack.append(row)
        for x in node.bases:
            self.ref("inherit", dotted(x), x)
        for x in node.body:
            self.visit(x)
        self.stack.pop()

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, flags: int) -> None:
        inside = self.stack[-1]["kind"] == "class"
        names = [dotted(x.func if isinstance(x, ast.Call) else x) for x in node.decorator_list]
        flags |= 2 if "staticmethod" in names else 0
        flags |= 4 if any(n and n.endswith("abstractmethod") for n in names) else 0
        args = [*node.args.posonlyargs, *node.args.args, *([node.args.vararg] if node.args.vararg else []), *node.args.kwonlyargs, *([node.args.kwarg] if node.args.kwarg else [])]
        sign = f"({', '.join(a.arg + (': ' + ast.unparse(a.annotation) if a.annotation else '') for a in args)})"
        kind = ("constructor" if node.name == "__init__" else "property" if "property" in names else "method") if inside else "function"
        self.stack.append(self.symbol(kind, node.name, node, sign, flags, ast.get_docstring(node)))
        for n, x in zip(names, node.decorator_list, strict=True):
            self.ref("decorate", n, x, args=self.arguments(x))
        for i, a in enumerate(args):
            self.symbol("parameter", a.arg, a, type_ref=ast.unparse(a.annotation) if a.annotation else None, position=i)
            if a.annotation:
                self.ref("type", dotted(a.annotation), a.annotation)
        if node.returns:
            self.ref("type", dotted(node.returns), node.returns)
        for x in node.body:
            self.visit(x)
        self.stack.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.function(node, 0)

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self.function(node, 1)

    def visit_Call(self, node: ast.Call) -> None:
        name = dotted(node.func)
        self.ref("call", name, node, args=self.arguments(node))
        if name:
            self.usage("call", name, node)
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        if node.exc is not None:
            self.ref("throw", dotted(node.exc.func if isinstance(node.exc, ast.Call) else node.exc), node)
        self.generic_visit(node)

    def assign(self, node: ast.Assign | ast.AnnAssign | ast.AugAssign) -> None:
        keep, self.statement = self.statement, node
        self.generic_visit(node)
        self.statement = keep

    visit_Assign = visit_AnnAssign = visit_AugAssign = assign

    def made(self) -> str | None:
        """The declared or constructed type of what the statement assigns."""
        s = self.statement
        if isinstance(s, ast.AnnAssign):
            return ast.unparse(s.annotation)
        name = dotted(s.value.func) if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) else None
        return name if name and name.rpartition(".")[2][:1].isupper() else None

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Store):
            holder = self.stack[-1]
            if (holder["id"], node.id) not in self.members:
                self.symbol("field" if holder["kind"] == "class" else "constant" if holder["kind"] == "module" and node.id.isupper() else "variable", node.id, node, type_ref=self.made())
            self.ref("write", node.id, node, whole=self.statement)
        elif isinstance(node.ctx, ast.Load):
            self.ref("read", node.id, node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        store = isinstance(node.ctx, ast.Store)
        if store and isinstance(node.value, ast.Name) and node.value.id == "self":
            owner = next((s for s in reversed(self.stack) if s["kind"] == "class"), None)
            if owner and (owner["id"], node.attr) not in self.members:
                keep, self.stack = self.stack, self.stack[: self.stack.index(owner) + 1]
                self.symbol("field", node.attr, node, type_ref=self.made())
                self.stack = keep
        self.ref("write" if store else "read", dotted(node), node, whole=self.statement if store else None)
        self.generic_visit(node)


def read_python(path: str, service: str, source: bytes) -> list[dict]:
    try:
        reader = Reader(path, service, source)
        reader.visit(ast.parse(source))
        return reader.rows
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"rec": "boundary", "kind": "parse_error", "name": type(e).__name__, "start_line": getattr(e, "lineno", None) or 1}]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RAW.split(", ")]
    for pdf in batches:
        for path, service, content in zip(pdf["path"], pdf["service_id"], pdf["content"], strict=True):
            out = pd.DataFrame([r | {"file_path": path} for r in read_python(path, service, bytes(content))], columns=columns, dtype=object)
            yield out.where(out.notna(), None)


def extract(ledger: DataFrame) -> DataFrame:
    """Rows of ``RAW`` for every file that is read; a file that does not parse gives one boundary row."""
    python = ledger.where("content is not null and lang = 'python'").select("path", "service_id", "content").mapInPandas(_extract, RAW)
    if ledger.where(F.col("content").isNotNull() & F.col("lang").isin(*tokens.BRACES)).isEmpty():
        return python
    from . import brace

    return python.unionByName(brace.extract(ledger), allowMissingColumns=True)
