"""``LineageGraph``: build a graph from a source tree, store it, open it, ask it.

Every answer is a DataFrame inside an ``Answer`` that says whether a budget cut it.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import text as X
from .operators import contracts as contract
from .operators import adjacency, capability, impact, risks, search, traverse
from .operators import resolve as R
from .operators.adjacency import Adjacency, Lookup
from .operators.nested import FORBIDDEN
from .operators.traverse import together
from .sources import code, git, packs, readers

PARTS = ("services", "files", "symbols", "nodes", "refs", "edges", "boundaries", "usage_sites", "coverage", "meta")


@dataclass
class Answer:
    """Rows and their envelope.

    ``boundaries(node, kind, detail)`` says where the answer stops short: nodes with neighbours beyond the depth (``depth_limit``), and the
    stops that were recorded at the nodes it holds (undecided calls, contract keys that are not literal).
    """

    rows: DataFrame
    total: int
    truncated: bool = False
    unresolved: int = 0
    notes: list[str] = field(default_factory=list)
    boundaries: DataFrame | None = None

    @property
    def complete(self) -> bool:
        """Nothing was cut, left undecided, or lies beyond the depth."""
        return not self.truncated and not self.unresolved and (self.boundaries is None or self.boundaries.isEmpty())

    def stops(self, most: int = 20) -> list[dict]:
        """The first boundaries, by kind and node."""
        return [] if self.boundaries is None else [r.asDict() for r in self.boundaries.orderBy("kind", "node", "detail").limit(most).collect()]


def build_digest(**tables: DataFrame) -> str:
    """A content digest that no row order, partitioning or clock changes: folded row hashes, counted per table."""
    out = hashlib.sha256()
    for name, df in sorted(tables.items()):
        h = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
        sums = [F.sum(F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(38,0)")) for i in (1, 13, 25, 37)]
        out.update(f"{name}{tuple(h.agg(F.count('*'), *sums).first())}".encode())
    return out.hexdigest()


def _write(df: DataFrame, path: str, stamp: bool = False) -> DataFrame:
    (df.withColumn("at", F.unix_micros(F.current_timestamp())).coalesce(1) if stamp else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


OBSERVED = ("file_path", "from_node", "kind", "name", "ref_text", "target", "receiver", "lang", "start_line", "end_line", "start_byte", "end_byte", "args")
#: Parts that are stored in bins by a key, to be read by it.
STORED = ("nodes", "edges")
#: Folders that name the version of a graph; the latest counts.
POINTER = "current"
NODE = ("id", "kind", "name", "qualified_name", "dotted", "signature", "docstring", "flags", "parent_id", "file_path", "lang", "type_ref", "position", "start_line", "end_line", "start_byte", "end_byte")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that counts, of a graph or of a version itself."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(jpath)]
    done = [f"{path}/{n}" for n in names if n.startswith(POINTER + "-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not done:
        return path
    return f"{path}/" + spark.read.parquet(*done).orderBy(F.desc("at"), "version").first().version


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: flags united, of every other column the smallest value that is there."""
    return nodes.groupBy("id").agg(*[(F.bit_or(c) if c == "flags" else F.min(c)).alias(c) for c in nodes.columns if c != "id"])


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new``: a new value wins where there is one, flags unite."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    latest = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("_age"), F.col(c).alias("v"))))["v"]
    return both.groupBy("id").agg(*[(F.bit_or(c) if c == "flags" else latest(c)).alias(c) for c in both.columns if c not in ("id", "_age")])


def purge_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of a file, and without edges that touch its nodes."""
    gone = nodes.where(F.col("file_path") == path).select("id")
    e = edges.where(F.coalesce(F.col("file_path") != path, F.lit(True)))
    e = e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.where(F.coalesce(F.col("file_path") != path, F.lit(True))), e.select(*edges.columns)


#: Searched columns and their weights, and the kinds that an exploration shows, best first.
SEARCHED = {"name": 10.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
KIND_RANK = ("class", "interface", "function", "method", "constructor", "property", "module", "contract")
#: Levels that the readers claim: references and data flow.
CLAIMS = {"python": "L2", "java": "L2", "typescript": "L2", "javascript": "L2"}


def payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON lines of a graph without any source text; a field that may hold some, at any depth, is refused."""

    def held(kind) -> set[str]:
        kind = getattr(kind, "elementType", kind)
        return {f.name.lower() for f in kind.fields} | {x for f in kind.fields for x in held(f.dataType)} if hasattr(kind, "fields") else set()

    for df in (nodes, edges):
        if bad := sorted(set(FORBIDDEN) & held(df.schema)):
            raise ValueError(f"fields with source text: {', '.join(bad)}")
    n = nodes.withColumn("flags", X.flag_names(F.col("flags"))) if "flags" in nodes.columns else nodes
    row = lambda df, kind: df.select(F.lit(kind).alias("type"), F.to_json(F.struct(*sorted(df.columns))).alias("row"))
    return row(n, "node").union(row(edges, "edge"))


def _data_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """PARAM_BINDS and RETURNS of resolved calls."""
    # calls only: a type that is made binds nothing
    calls = refs.where("kind = 'call' and dst is not null").where(~F.col("dst_kind").isin(*S.TYPES)).withColumn("call", F.concat_ws(":", "file_path", "start_byte", "end_byte", "ref_text"))
    hit = calls.select("call", F.col("dst").alias("callee"), "file_path", F.col("start_line").alias("line"), "start_byte", "end_byte")
    args = calls.select("call", "from_node", "file_path", F.col("start_line").alias("line"), F.explode("args").alias("a")).where("a.name is null")
    values = nodes.where("kind in ('parameter', 'variable')").groupBy(F.col("parent_id").alias("from_node"), F.col("name").alias("said")).agg(F.min("id").alias("value"), F.count("*").alias("k")).where("k = 1")
    args = args.withColumn("said", F.col("a.text")).join(values, ["from_node", "said"], "left")
    args = args.select("call", F.col("a.index").alias("position"), F.coalesce("value", "from_node").alias("src"), "file_path", "line")
    params = nodes.where("kind = 'parameter'").select("id", "parent_id", "name", "position")
    writes = refs.where("kind = 'write' and dst is not null").select(F.col("dst").alias("value"), "file_path", "start_byte", "end_byte")
    out = R.param_binds(hit.select("call", "callee"), args, params).unionByName(R.returns(hit, writes), allowMissingColumns=True)
    out = out.where("src <> dst").withColumns({"resolution": F.lit("inferred"), "evidence_tier": F.lit("heuristic")})
    return out.withColumn("evidence_label", F.lower("kind"))


def _pack(spark: SparkSession, path: str | None, tmp: str) -> tuple[str, DataFrame] | None:
    return None if path is None else (path, _write(packs.packs(spark, path), f"{tmp}/pack"))


def _adapters(spark: SparkSession, pack: tuple[str, DataFrame] | None) -> DataFrame:
    """The adapters that count: those that are shipped, then those of the project."""
    own = contract.adapters(spark)
    return own if pack is None else own.unionByName(packs.adapters(pack[1], len(contract.SHIPPED)))


def _adapter_digest(spark: SparkSession, pack: tuple[str, DataFrame] | None) -> str:
    return build_digest(adapters=_adapters(spark, pack))


def _precise(spark: SparkSession, scip: str | None, tmp: str, ledger: DataFrame, nodes: DataFrame) -> DataFrame | None:
    return None if scip is None else _write(readers.precise(readers.scip(spark, scip), ledger, nodes), f"{tmp}/precise")


def _broken(raw: DataFrame) -> DataFrame:
    return raw.where("rec = 'boundary'").select("file_path", "kind", F.col("name").alias("detail"), F.col("start_line").alias("line"))


def _usage(raw: DataFrame) -> DataFrame:
    return raw.where("rec = 'usage'").select(F.col("name").alias("symbol_name"), F.col("kind").alias("usage_type"), "file_path", "start_line", F.col("from_node").alias("calling_symbol_id"), "context_before", "context_line", "context_after")


def _search_at(version: str) -> str:
    """The folder of the search index, which the versions of a graph share; each names its segments."""
    return f"{version.rsplit('/', 1)[0]}/search"


def _searched(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind <> 'parameter'").select("id", *SEARCHED)


def _finish(spark: SparkSession, tmp: str, ledger: DataFrame, broken: DataFrame, symbols: DataFrame, refs: DataFrame, usage: DataFrame, root: str, last: LineageGraph | None = None, scip: str | None = None, pack: tuple[str, DataFrame] | None = None) -> None:
    """What follows from symbols and resolved references: services, files, contracts, nodes, edges, boundaries, coverage, digest."""
    found = _write(readers.services(ledger), f"{tmp}/services")
    ledger = readers.locate(ledger, found)
    status = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("bad"), "error").otherwise("ok")
    files = ledger.drop("content", "manifest").join(broken.select(F.col("file_path").alias("path"), F.lit(True).alias("bad")).distinct(), "path", "left")
    files = _write(files.withColumn("parse_status", status).drop("bad"), f"{tmp}/files")
    nodes = merge_nodes(symbols).join(files.select(F.col("path").alias("file_path"), "service_id"), "file_path", "left")
    contracts, contract_edges, loose = contract.detect(refs.withColumnRenamed("name", "ref_name"), _adapters(spark, pack))
    nodes = nodes.unionByName(contracts.select("id", "kind", "name", "qualified_name", "lang", "file_path", "start_line", "end_line", F.lit(0).alias("flags")), allowMissingColumns=True)
    contract_edges = _write(contract_edges, f"{tmp}/contract_edges")
    bins = adjacency.bins_for(refs.count())
    nodes = Lookup.write(contract.entry_flags(nodes, contract_edges), "id", f"{tmp}/nodes", bins).all()
    edges = R.edges_of(refs, nodes).unionByName(contract_edges, allowMissingColumns=True).unionByName(_data_edges(refs, nodes), allowMissingColumns=True)
    edges = edges.groupBy("src", "dst", "kind", "line", "start_byte").agg(*[F.min(c).alias(c) for c in ("file_path", "resolution", "evidence_tier", "evidence_label")])
    stops = broken.select(F.lit(None).cast("string").alias("node_id"), "file_path", "kind", "detail", "line")
    stops = stops.unionByName(loose, allowMissingColumns=True).unionByName(R.boundaries_of(refs), allowMissingColumns=True)
    listed = lambda: last.found.change(_searched(last.nodes), _searched(nodes), "id") if last else search.Segments.build(_searched(nodes), "id", SEARCHED, _search_at(tmp))
    edges, stops, found, *_ = together(
        lambda: Lookup.write(edges, "src", f"{tmp}/edges", bins).all(), lambda: _write(stops, f"{tmp}/boundaries"), listed, lambda: Lookup.write(_names(nodes), "said", f"{tmp}/names", bins),
        lambda: _write(usage, f"{tmp}/usage_sites"), lambda: _write(R.coverage(refs), f"{tmp}/coverage"),
    )
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    sums, _, held = together(lambda: build_digest(nodes=nodes, edges=edges, refs=refs, boundaries=stops), lambda: Lookup.write(edges, "dst", f"{tmp}/edges_by_dst", bins), lambda: ends.join(nodes, "id", "left_anti").isEmpty())
    if not held:
        raise ValueError("an edge ends at no node")
    at = git.provenance(root)
    _write(spark.createDataFrame([(S.SCHEMA_VERSION, sums, root, at.commit_sha, at.branch, at.dirty, bins, found.names, scip, pack and pack[0], _adapter_digest(spark, pack))], "schema_version int, build_digest string, project_root string, commit_sha string, branch string, dirty boolean, bins int, segments array<string>, scip string, pack string, adapter_digest string"), f"{tmp}/meta")
    _delete(spark, *[f"{tmp}/{part}" for part in ("raw", "ledger", "touched", "precise", "contract_edges")])


def _delete(spark: SparkSession, *paths: str) -> None:
    for x in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(x)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Versions of a graph that stay on disk, for readers that still hold one.
VERSIONS = 3


def _publish(spark: SparkSession, tmp: str, out: str) -> None:
    """Name the version that counts in one small file, so that a reader sees the old graph or the new one; the oldest versions go."""
    out, own = out.rstrip("/"), tmp.rsplit("/", 1)[-1]
    _write(spark.createDataFrame([(own,)], "version string"), f"{out}/{POINTER}-{uuid.uuid4().hex}", stamp=True)
    past = spark.read.parquet(f"{out}/{POINTER}-*").select("version", "at", F.col("_metadata.file_path").alias("file")).orderBy(F.desc("at"), "version").collect()
    _delete(spark, *[x for r in past[VERSIONS:] for x in (f"{out}/{r.version}", r.file.rsplit("/", 1)[0])])
    used = {x for r in spark.read.parquet(*[f"{out}/{r.version}/meta" for r in past[:VERSIONS]]).select("segments").collect() for x in r.segments}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/search")
    names = [x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    _delete(spark, *[f"{out}/search/{n}" for n in names if n not in used])


def _names(nodes: DataFrame) -> DataFrame:
    """``(said, how, id)``: what a symbol may be called, first by its id or full names, then by its plain name."""
    said = lambda c, how: F.struct(F.col(c).alias("said"), F.lit(how).alias("how"))
    plain = F.struct(F.when(F.col("kind") != "parameter", F.col("name")).alias("said"), F.lit(1).alias("how"))
    return nodes.select("id", F.inline(F.array(said("id", 0), said("qualified_name", 0), said("dotted", 0), plain))).where("said is not null").distinct()


class LineageGraph:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path
        self.path = path = current(spark, path)
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta is None or meta.schema_version != S.SCHEMA_VERSION:
            raise S.SchemaMismatch(f"{path} holds schema {meta and meta.schema_version}, not {S.SCHEMA_VERSION}")
        self.digest, self.scip, self.pack, self.adapter_digest = meta.build_digest, meta.scip, meta.pack, meta.adapter_digest
        self.packed = spark.read.parquet(f"{path}/pack") if meta.pack else None
        self.provenance = git.Provenance(*map(meta.asDict().get, ("commit_sha", "branch", "dirty")))
        for part in PARTS[:-1]:
            if part not in STORED:
                setattr(self, part, spark.read.parquet(f"{path}/{part}"))
        self.adjacency = Adjacency.open(spark, path, meta.bins)
        self.by_id = Lookup.open(spark, f"{path}/nodes", "id", meta.bins)
        self.by_name = Lookup.open(spark, f"{path}/names", "said", meta.bins)
        self.edges, self.nodes = self.adjacency.edges, self.by_id.all()
        self.found = search.Segments(spark, _search_at(path), list(meta.segments), SEARCHED)

    @classmethod
    def build(cls, spark: SparkSession, root: str, out: str, service: str = "root", scip: str | None = None, pack: str | None = None) -> LineageGraph:
        """Read a tree into ``out``: all or nothing, since the version that counts is named when its last table is written.

        ``scip`` is a SCIP index of the tree; what it says wins over a name that is only known somewhere in the project.
        ``pack`` is a folder with the project's own adapters and rules (see ``packs``), which come after those that are shipped.
        """
        tmp = f"{out.rstrip('/')}/v-{uuid.uuid4().hex}"
        # written first, so that files that change meanwhile cannot give a ledger and symbols of different states
        ledger = _write(code.files(spark, root, service), f"{tmp}/ledger")
        raw = _write(code.extract(ledger.withColumn("service_id", F.lit(service))), f"{tmp}/raw")
        symbols = _write(raw.where("rec = 'node'").select(*NODE), f"{tmp}/symbols")
        nodes = merge_nodes(symbols)
        refs = _write(R.resolve(raw.where("rec = 'ref'").select(*OBSERVED), nodes, _precise(spark, scip, tmp, ledger, nodes)), f"{tmp}/refs")
        _finish(spark, tmp, ledger, _broken(raw), symbols, refs, _usage(raw), root, scip=scip, pack=_pack(spark, pack, tmp))
        _publish(spark, tmp, out)
        return cls(spark, out)

    def update(self, root: str, service: str = "root") -> LineageGraph:
        """The graph of ``root`` as it is now, from this one: only files that differ are read and only references that they may touch are resolved.

        The new version holds what a build would; this one stays readable.  Without a difference it is returned itself.
        """
        spark, out = self.spark, self.root
        tmp = f"{out.rstrip('/')}/v-{uuid.uuid4().hex}"
        ledger = code.files(spark, root, service)
        now = ledger.select("path", "content_hash", "size_bytes", F.lit(True).alias("here"))
        was = self.files.select("path", F.col("content_hash").alias("h"), F.col("size_bytes").alias("s"), F.lit(True).alias("there"))
        same = F.col("here") & F.col("there") & F.col("content_hash").eqNullSafe(F.col("h")) & F.col("size_bytes").eqNullSafe(F.col("s"))
        pack = _pack(spark, self.pack, tmp)
        touched = _write(now.join(was, "path", "full").where(~F.coalesce(same, F.lit(False))).select(F.col("path").alias("file_path"), F.coalesce("here", F.lit(False)).alias("here")), f"{tmp}/touched")
        if touched.isEmpty() and _adapter_digest(spark, pack) == self.adapter_digest:
            _delete(spark, tmp)
            return self
        ledger = _write(ledger, f"{tmp}/ledger")
        read = ledger.join(touched.where("here").select(F.col("file_path").alias("path")), "path", "left_semi")
        raw = _write(code.extract(read.withColumn("service_id", F.lit(service))), f"{tmp}/raw")
        kept = lambda df: df.join(touched.select("file_path"), "file_path", "left_anti").select(*df.columns)
        symbols = _write(kept(self.symbols).unionByName(raw.where("rec = 'node'").select(*NODE)), f"{tmp}/symbols")
        old, nodes = merge_nodes(self.symbols), merge_nodes(symbols)
        stay, new = kept(self.refs), raw.where("rec = 'ref'").select(*OBSERVED)
        again, inherits = R.affected(self.refs, stay, new, old, nodes)
        precise = _precise(spark, self.scip, tmp, ledger, nodes)
        if precise is not None:  # what the index answered may have gone stale
            again = again.union(stay.where("step = 'precise_index'").select(*again.columns)).dropDuplicates(list(R.AT))
        fresh = R.resolve(again.select(*OBSERVED).union(new), nodes, precise, inherits)
        stay = stay.join(again.select(*R.AT), [stay[c].eqNullSafe(again[c]) for c in R.AT], "left_anti").select(*stay.columns)
        refs = _write(stay.unionByName(fresh), f"{tmp}/refs")
        broken = kept(self.boundaries.where("kind = 'parse_error'")).select("file_path", "kind", "detail", "line").unionByName(_broken(raw))
        _finish(spark, tmp, ledger, broken, symbols, refs, kept(self.usage_sites).unionByName(_usage(raw)), root, self, self.scip, pack)
        _publish(spark, tmp, out)
        return type(self)(spark, out)

    def reopen(self) -> LineageGraph:
        """This graph, or its newest version if another one counts by now."""
        return self if current(self.spark, self.root) == self.path else type(self)(self.spark, self.root)

    def verify(self, root: str, beside: str) -> bool:
        """Whether a second build of ``root``, stored at ``beside``, gives the same content."""
        return type(self).build(self.spark, root, beside).digest == self.digest

    def capabilities(self) -> DataFrame:
        """What each language of the graph shows against the level that its reader claims."""
        return capability.matrix(self.nodes, self.edges, CLAIMS)

    def node(self, symbol: str) -> str:
        """An id by id, by qualified or dotted name, or by a plain name, if exactly one symbol is meant."""
        hits = self.by_name.of(symbol)
        best = hits.agg(F.min("how")).first()[0]
        found = [r.id for r in hits.where(F.col("how") == best).select("id").distinct().limit(2).collect()] if best is not None else []
        if len(found) != 1:
            raise KeyError(f"{symbol}: {'several symbols' if found else 'no symbol'}")
        return found[0]

    def _walk(self, symbol: str, direction: str, kinds: tuple[str, ...], depth: int, limit: int) -> Answer:
        whole = traverse.walk(self.adjacency, [self.node(symbol)], direction, kinds, depth)
        w = whole.where("depth > 0")
        total, bins = self.by_id.touched(w.select("node"))
        nodes = self.by_id.near(w.select("node"), (total, bins))
        rows = w.join(nodes.withColumnRenamed("id", "node").select("node", "name", F.col("kind").alias("node_kind"), "qualified_name", "file_path", "start_line"), "node")
        open_ = self.refs.where("status = 'ambiguous'").join(w.select(F.col("node").alias("from_node")), "from_node", "left_semi").count()
        cut = traverse.cut_off(self.adjacency, whole, direction, kinds, depth).select("node", F.lit("depth_limit").alias("kind"), F.concat(F.col("unseen").cast("string"), F.lit(" neighbours beyond")).alias("detail"))
        known = self.boundaries.select(F.col("node_id").alias("node"), "kind", "detail").join(whole.select("node").distinct(), "node", "left_semi")
        return Answer(rows.orderBy("depth", "qualified_name").limit(limit), total, total > limit, open_, boundaries=cut.unionByName(known.select("node", "kind", "detail")))

    def boundaries_of(self, symbol: str) -> DataFrame:
        """The stops recorded at a symbol: ``kind, detail, candidates, line``."""
        return self.boundaries.where(F.col("node_id") == self.node(symbol)).select("kind", "detail", "candidates", "line").orderBy("line", "kind", "detail")

    def unresolved_of(self, symbol: str) -> DataFrame:
        """References of a symbol that have no one answer, with the reason."""
        r = self.refs.where((F.col("from_node") == self.node(symbol)) & F.col("status").isin("ambiguous", "external"))
        return r.select("kind", "ref_text", "status", "reason", "candidates", "start_line").orderBy("start_line", "ref_text")

    def callers_of(self, symbol: str, depth: int = 1, limit: int = 200) -> Answer:
        return self._walk(symbol, "backward", ("CALLS", "INSTANTIATES"), depth, limit)

    def callees_of(self, symbol: str, depth: int = 1, limit: int = 200) -> Answer:
        return self._walk(symbol, "forward", ("CALLS", "INSTANTIATES"), depth, limit)

    def impact_of(self, symbol: str, depth: int = 6, limit: int = 200) -> Answer:
        return self._walk(symbol, "backward", S.DEPENDENT, depth, limit)

    def impact_of_line(self, path: str, line: int, depth: int = 8, limit: int = 200) -> Answer:
        """What depends on the symbol behind a line; ``notes`` holds the kind of change."""
        one = self.spark.createDataFrame([(path, line)], "path string, line int")
        hit = impact.retarget(one, self.nodes, self.edges).first()
        if hit is None or hit.target is None:
            raise KeyError(f"{path}:{line}: no symbol")
        out = self._walk(hit.target, "backward", S.DEPENDENT, depth, limit)
        out.notes = [hit.change]
        return out

    def impact_of_diff(self, diff: str) -> DataFrame:
        """Added lines of a unified diff with their kind of change and the symbol they touch."""
        d = impact.diff_lines(self.spark.createDataFrame([(0, diff)], "id int, diff string"), "id", "diff")
        return impact.retarget(d.select("path", "line"), self.nodes, self.edges)

    def map_stacktrace(self, trace: str) -> DataFrame:
        return impact.map_stacktrace(self.spark.createDataFrame([(0, trace)], "id int, trace string"), "id", "trace", self.files, self.nodes).drop("id").orderBy("at", "file")

    def dataflow_of(self, symbol: str, direction: str = "downstream", depth: int = 8, limit: int = 200) -> Answer:
        if direction not in ("upstream", "downstream"):
            raise ValueError(f"direction must be upstream or downstream, not {direction!r}")
        return self._walk(symbol, "backward" if direction == "upstream" else "forward", S.DATA_FLOW, depth, limit)

    def explain(self, a: str, b: str) -> DataFrame:
        return self.adjacency.forward.of(self.node(a)).where(F.col("dst") == self.node(b)).orderBy("kind", "line")

    def trace_flow(self, symbol: str, depth: int = 6, budget: int = 60) -> list[dict]:
        return traverse.trace_flow(self.adjacency, self.node(symbol), ("CALLS", "INSTANTIATES"), depth, budget)

    def contract_map(self) -> DataFrame:
        """Every contract with its exposers and consumers, and whether one side is missing."""
        k = self.nodes.where("kind = 'contract'").select(F.col("id").alias("contract"), "name")
        e = self.edges.where(F.col("kind").isin(*S.CONTRACT)).select(F.col("dst").alias("contract"), "src", F.col("kind").alias("role"))
        side = lambda r: F.countDistinct(F.when(F.col("role") == r, F.col("src")))
        out = k.join(e, "contract", "left").groupBy("contract", "name").agg(side("EXPOSES").alias("exposers"), side("CONSUMES").alias("consumers"))
        return out.withColumns({"dangling": F.expr("consumers > 0 and exposers = 0"), "unconsumed": F.expr("exposers > 0 and consumers = 0")}).orderBy("name")

    def entry_points(self) -> DataFrame:
        e = self.edges.where("kind = 'EXPOSES'").select(F.col("src").alias("id"), F.col("dst").alias("contract")).distinct()
        return self.nodes.join(e, "id").select("id", "name", "kind", "contract").orderBy("id", "contract")

    def refused(self) -> DataFrame:
        """Entries of the project's pack that were not taken: ``file, entry, refused``."""
        none = self.spark.createDataFrame([], "file string, entry int, refused string")
        return none if self.packed is None else packs.refused(self.packed).orderBy("file", "entry")

    def risks(self, markers: tuple[str, ...] = (), rows: tuple = risks.BLOCKING, limit: int = 200) -> Answer:
        """Forbidden calls from asynchronous frames, by ``rows`` and by the rules of the project's pack."""
        rule = risks.rules(self.spark, rows)
        rule = rule if self.packed is None else rule.unionByName(packs.rules(self.packed))
        calls = self.edges.where("kind = 'CALLS'").select("src", "dst", "evidence_tier")
        outside = self.refs.where("kind = 'call' and status = 'external'").select(F.col("from_node").alias("src"), F.coalesce("target", "ref_text").alias("target")).distinct()
        entry = self.nodes.where(F.col("flags").bitwiseAND(F.lit(256)) != 0).select("id")
        named = self.nodes.select("id", F.coalesce("dotted", "qualified_name").alias("qualified_name"), "lang")
        found = risks.find(risks.async_frames(self.nodes, self.refs, markers), calls, outside, named, rule, entry)
        total = found.count()
        return Answer(found.orderBy(F.desc("severity"), "distance", "at", "target").limit(limit), total, total > limit)

    def coverage_report(self) -> DataFrame:
        """Files with their counters; skipped ones too, with the reason."""
        return self.files.select("path", "lang", "parse_status", "skip_reason").join(self.coverage.withColumnRenamed("file_path", "path"), "path", "left").orderBy("path")

    def explore(self, question: str, most: int = 8) -> DataFrame:
        """The best symbols for a question: by terms covered, kind and rank, each with its direct callers."""
        hits = search.ranked(self.found.index(), question, "or").join(self.nodes.select("id", "kind", "name", "qualified_name"), "id")
        rank = F.coalesce(F.array_position(F.array(*map(F.lit, KIND_RANK)), F.col("kind")), F.lit(0))
        hits = hits.where(rank > 0).orderBy(F.desc("hits"), rank, "score", "id").limit(most)
        near = self.edges.where("kind in ('CALLS', 'INSTANTIATES')").select(F.col("dst").alias("id"), "src").distinct()
        called = hits.select("id").join(near, "id").groupBy("id").agg(F.count("*").alias("callers"))
        return hits.join(called, "id", "left").select("id", "kind", "name", "qualified_name", "hits", "score", F.coalesce("callers", F.lit(0)).alias("callers")).orderBy(F.desc("hits"), rank, "score", "id")

    def find_paths(self, start: str, goal: str, depth: int = 6, paths: int = 6) -> DataFrame:
        return traverse.find_paths(self.adjacency, self.node(start), self.node(goal), S.CALL_CHAIN, depth, paths)

    def search(self, *terms: str, mode: str | None = None, limit: int = 20) -> DataFrame:
        """Symbols by weighted columns: rows with all terms, or with any where none has all."""
        hits = search.ranked(self.found.index(), " ".join(terms), mode)
        return hits.join(self.nodes.select("id", "kind", "name", "qualified_name"), "id").orderBy("score", "id").limit(limit)

    def find_usage(self, name: str, kind: str | None = None, limit: int = 200) -> DataFrame:
        u = self.usage_sites.where(F.col("symbol_name") == name)
        return (u.where(F.col("usage_type") == kind) if kind else u).orderBy("file_path", "start_line").limit(limit)

    def at_line(self, path: str, line: int) -> DataFrame:
        """Symbols that hold a line, innermost last."""
        n = self.nodes.where((F.col("file_path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
        return n.orderBy((F.col("end_line") - F.col("start_line")).desc(), "start_line")
