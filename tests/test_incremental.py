"""The stored graph: reads that touch few files, updates that equal builds, following a tree."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from skein.graph import LineageGraph, current
from skein.operators import resolve as R
from skein.operators.adjacency import Adjacency, Lookup
from skein.operators.traverse import find_paths, trace_flow, walk
from skein.sources import code
from skein.streaming.live import Follower

TREE = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Root:\n    def top(self):\n        return 1\n\n\nclass Base(Root):\n    def save(self, value):\n        return self.top()\n",
    "pkg/repo.py": "from pkg.base import Base\n\n\nclass Repo(Base):\n    def store(self, item):\n        done = self.save(item)\n        again = self.save(done)\n        return again\n",
    "app.py": "from pkg.repo import Repo\nimport pkg.util as u\n\n\ndef main(repo: Repo, thing):\n    repo.store(thing)\n    repo.save(thing)\n    u.helper(thing)\n    lonely()\n",
    "pkg/util.py": "def helper(x):\n    return x\n",
    "other.py": "def lonely():\n    return helper(1)\n",
    "api.py": "@app.get('/items/{id}')\ndef items(id):\n    return id\n",
    "notes/readme.txt": "words",
    "node_modules/x.py": "def ignored():\n    pass\n",
    "big.py": "x = 1\n" * 400_000,
}


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def edges(g):
    n = {r.id: r["dotted"] for r in g.nodes.collect()}
    return {(n[r.src], r.kind, n[r.dst]) for r in g.edges.collect()}


#: Each edit with edges that it brings, edges that it takes, and whether a whole build is made to compare.
EDITS = [
    ({"pkg/util.py": "# moved down\n\n\ndef helper(x):\n    return x\n", "third.py": "def lonely():\n    pass\n"}, (), [("app.main", "CALLS", "other.lonely")], False),
    ({"third.py": None, "pkg/repo.py": "class Repo:\n    def store(self, item):\n        return item\n"}, [("app.main", "CALLS", "other.lonely")], [("pkg.repo.Repo", "INHERITS", "pkg.base.Base")], True),
    ({"pkg/repo.py": TREE["pkg/repo.py"], "pkg/base.py": "class Base:\n    def save(self, value):\n        return 2\n", "other.py": "def lonely(:\n", "api.py": None, "pkg/util.py": None}, [("app.main", "CALLS", "pkg.base.Base.save")], [("app.main", "CALLS", "other.lonely"), ("app.main", "CALLS", "pkg.util.helper"), ("pkg.base.Base", "INHERITS", "pkg.base.Root")], True),
]


def test_updates_equal_builds(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, TREE)
    g = LineageGraph.build(spark, str(root), str(tmp_path / "graph"))
    assert ("app.main", "CALLS", "pkg.base.Base.save") in edges(g) and ("pkg.repo.Repo.store", "CALLS", "pkg.base.Base.save") in edges(g)
    assert g.update(str(root)) is g and g.reopen() is g
    first = g
    for change, brings, takes, compared in EDITS:
        for path, text in change.items():
            (root / path).unlink() if text is None else write(root, {path: text})
        new = g.update(str(root))
        if compared:
            full = LineageGraph.build(spark, str(root), str(tmp_path / f"full{time.time_ns()}"))
            assert new.digest == full.digest != g.digest, change
            assert {r.path: r.content_hash for r in new.files.collect()} == {r.path: r.content_hash for r in full.files.collect()}
        now = edges(new)
        assert set(brings) <= now and not set(takes) & now, change
        assert g.reopen().path == new.path
        g = new
    assert current(spark, str(tmp_path / "graph")) == g.path
    versions = [p.name for p in (tmp_path / "graph").iterdir() if p.name.startswith("v-")]
    assert len(versions) == 3 and first.path.rsplit("/", 1)[-1] not in versions


def test_update_resolves_only_what_a_change_may_touch(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, TREE)
    g = LineageGraph.build(spark, str(root), str(tmp_path / "graph"))
    old = g.symbols
    gone = old.where("file_path = 'pkg/util.py'")
    stay = g.refs.where("file_path <> 'pkg/util.py'")
    new = g.refs.limit(0).select("file_path", "from_node", "kind", "name", "ref_text", "target", "receiver", "lang", "start_line", "end_line", "start_byte", "end_byte", "args")
    again, _ = R.affected(g.refs, stay, new, old, old.join(gone.select("id"), "id", "left_anti").select(*old.columns))
    assert {r.name for r in again.collect()} <= {"helper", "util", "x", "u"} and again.count() < stay.count() / 2
    none, _ = R.affected(g.refs, stay, new, old, old)
    assert none.count() == 0


def test_ledger_keeps_empty_files_and_leaves_large_and_ignored_ones_unread(spark, tmp_path):
    write(tmp_path, TREE)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(code.MAX_BYTES))
    try:
        rows = {r.path: r for r in code.files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows["pkg/__init__.py"].size_bytes == 0 and rows["pkg/__init__.py"].skip_reason is None
    assert rows["big.py"].skip_reason == "too_large" and rows["big.py"].content is None
    assert set(rows) == set(TREE) - {"node_modules/x.py"}


def test_empty_package_is_a_module_that_imports_find(spark, tmp_path):
    write(tmp_path / "t", {"app/__init__.py": "", "use.py": "import app\n"})
    g = LineageGraph.build(spark, str(tmp_path / "t"), str(tmp_path / "g"))
    assert ("use", "IMPORTS", "app") in edges(g)


def test_returns_keep_their_lines_and_types_bind_nothing(spark, tmp_path):
    write(tmp_path / "t", {"m.py": "class T:\n    def __init__(self, a):\n        pass\n\n\ndef f(x):\n    return x\n\n\ndef go(v):\n    r = f(v)\n    r = f(r)\n    t = T(v)\n"})
    g = LineageGraph.build(spark, str(tmp_path / "t"), str(tmp_path / "g"))
    n = {r.id: r["dotted"] for r in g.nodes.collect()}
    flow = {(n[r.src], n[r.dst], r.kind, r.line) for r in g.edges.where("kind in ('RETURNS', 'PARAM_BINDS')").collect()}
    assert {("m.f", "m.go.r", "RETURNS", 11), ("m.f", "m.go.r", "RETURNS", 12)} <= flow
    assert not any("T" in a.split(".") or "__init__" in b for a, b, _, _ in flow)


def test_deep_containers_and_bases_have_no_limit(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(24)] + [("a", "b"), ("b", "a")], "id string, parent_id string")
    up = R.ancestors(nodes)
    assert up.where("id = 'n23'").count() == 24 and up.where("id = 'n23' and scope = 'n0' and depth = 23").count() == 1
    assert {(r.id, r.scope) for r in up.where("id in ('a', 'b')").collect()} == {("a", "a"), ("a", "b"), ("b", "b"), ("b", "a")}
    chain = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(20)] + [("x", "y"), ("y", "x")], "src string, dst string")
    b = R.bases(chain)
    assert b.where("id = 't0'").count() == 20 and b.where("id = 'x'").count() == 1


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    e = spark.range(40_000).select(F.concat(F.lit("n"), F.col("id") % 900).alias("src"), F.concat(F.lit("n"), F.xxhash64("id") % 450 + 450).alias("dst"), F.when(F.col("id") % 3 == 0, "READS").otherwise("CALLS").alias("kind"))
    e = e.union(spark.range(20_000).select(F.concat(F.lit("n"), F.col("id") % 900), F.lit("hub"), F.lit("CALLS")))
    e = e.persist()
    yield e, Adjacency.write(e, str(tmp_path_factory.mktemp("adj")))
    e.unpersist()


def same(a, b):
    rows = lambda df: sorted(map(str, df.collect()))
    return rows(a) == rows(b)


@pytest.mark.parametrize("direction,start", [("forward", "n7"), ("backward", "hub"), ("forward", "nowhere")])
def test_stored_walks_equal_walks_over_a_table(stored, spark, direction, start):
    e, adj = stored
    for depth in (1, 3):
        assert same(walk(adj, [start], direction, ("CALLS",), depth), walk(e, spark.createDataFrame([(start,)], "node string"), direction, ("CALLS",), depth))
    if start == "n7":
        assert same(find_paths(adj, "n7", "hub", ("CALLS",), 2, None), find_paths(e, "n7", "hub", ("CALLS",), 2, None))
        assert trace_flow(adj, "n7", ("CALLS",), 2, 20) == trace_flow(e, "n7", ("CALLS",), 2, 20)


def test_one_hop_reads_few_files_and_writes_none(stored, spark, tmp_path):
    _, adj = stored
    every = adj.backward.table.select("_metadata.file_path").distinct().count()
    read = adj.backward.table.where(F.col("bin").isin(adj.backward.touched(spark.createDataFrame([("n500",)], "k string"))[1])).select("_metadata.file_path").distinct().count()
    assert read <= every * 0.05
    shared = str(spark.sparkContext._jsc.sc().getCheckpointDir().get()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    before = set(__import__("pathlib").Path(shared.removeprefix("file:")).rglob("*")) if shared else set()
    w = walk(adj, ["n500"], "backward", ("CALLS",), 1)
    plan = w._jdf.queryExecution().toString()
    assert w.count() > 1 and "PartitionFilters: [bin" in plan.replace("isnotnull(bin", "bin")
    if shared:
        assert set(__import__("pathlib").Path(shared.removeprefix("file:")).rglob("*")) == before


def test_lookup_of_keys(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("é", 3), (None, 4), ("a", 5)], "k string, v int")
    look = Lookup.write(df, "k", str(tmp_path / "l"), 32)
    assert sorted(r.v for r in look.of("a", "é").collect()) == [1, 3, 5] and look.of().count() == 0
    assert sorted(r.v for r in look.all().collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.v for r in look.near(spark.createDataFrame([("b",)] * 100, "k string")).where("k = 'b'").collect()) == [2]


def test_follower_waits_for_quiet_and_sees_deletions(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, {"a.py": "def a():\n    pass\n", "b.py": "def b():\n    a()\n"})
    f = Follower(spark, str(root), str(tmp_path / "g"), quiet=1.5)
    assert f.step(0.0) is None and f.step(1.0) is None
    g = f.step(2.0)
    assert ("b.b", "CALLS", "a.a") in edges(g) and f.step(9.0) is None
    (root / "a.py").unlink()
    assert f.step(10.0) is None
    write(root, {"c.py": "x = 1\n"})
    assert f.step(11.0) is None and f.step(12.0) is None
    g = f.step(13.0)
    assert ("b.b", "CALLS", "a.a") not in edges(g) and {r.path for r in g.files.collect()} == {"b.py", "c.py"}
    shutil.rmtree(root)
    root.mkdir()
