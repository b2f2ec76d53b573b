import pytest

from skein import schema as S
from skein.graph import LineageGraph, build_digest
from skein.streaming.live import watch, windowed

A = '''"""Shapes."""
import util.text as tx
from util.text import clean

LIMIT = 3


class Base:
    def area(self):
        return self.side()

    def side(self):
        return LIMIT


class Square(Base):
    def __init__(self, width: int):
        self.width = width

    async def render(self):
        return clean(tx.pad(self.width))


def main():
    s = Square(2)
    raise Oops()
'''
B = '''def clean(x):
    return pad(x)


def pad(x):
    return x


def same():
    pass
'''
C = '''def same():
    pass


def caller(o):
    o.same()
    o.nothing()
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {"app/shapes.py": A, "util/text.py": B, "util/more.py": C, "bad.py": "def (", "x.java": "class X {}", "x.go": "package x", ".hidden/h.py": "a = 1", "data.py": "x\0", "notes.txt": "hi"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def graph(spark, tree, tmp_path_factory):
    return LineageGraph.build(spark, str(tree), str(tmp_path_factory.mktemp("g") / "graph"))


def names(df):
    return {r.name for r in df.collect()}


def test_ledger(graph):
    got = {r.path: (r.parse_status, r.skip_reason) for r in graph.files.collect()}
    assert got == {"app/shapes.py": ("ok", None), "util/text.py": ("ok", None), "util/more.py": ("ok", None), "bad.py": ("error", None), "x.java": ("ok", None), "x.go": ("skipped", "missing_grammar"), "data.py": ("skipped", "binary"), "notes.txt": ("skipped", "unknown_dialect")}


def test_symbols(graph):
    kinds = {(r["dotted"], r.kind, r["flags"]) for r in graph.nodes.collect()}
    assert {("app.shapes", "module", 0), ("app.shapes.Square", "class", 0), ("app.shapes.Square.__init__", "constructor", 0), ("app.shapes.Square.render", "method", 1), ("app.shapes.Square.width", "field", 0), ("app.shapes.LIMIT", "constant", 0)} <= kinds


def test_resolution(graph):
    n = {r.id: r["dotted"] for r in graph.nodes.collect()}
    got = {(n[r.src], n[r.dst], r.kind, r.resolution) for r in graph.edges.collect()}
    for e in (
        ("app.shapes.Square.render", "util.text.clean", "CALLS", "inferred"), ("app.shapes.Square.render", "util.text.pad", "CALLS", "inferred"), ("util.text.clean", "util.text.pad", "CALLS", "exact"),
        ("app.shapes.Base.area", "app.shapes.Base.side", "CALLS", "exact"), ("app.shapes.main", "app.shapes.Square", "INSTANTIATES", "exact"), ("app.shapes.Square", "app.shapes.Base", "INHERITS", "exact"),
        ("app.shapes.Base.side", "app.shapes.LIMIT", "READS", "exact"), ("app.shapes", "util.text.clean", "IMPORTS", "inferred"), ("app.shapes", "app.shapes.Base", "CONTAINS", "exact"),
    ):
        assert e in got
    status = {(r.ref_text, r.status, r.n_candidates) for r in graph.refs.where("kind in ('call', 'throw')").collect()}
    assert ("o.same", "ambiguous", 2) in status and ("o.nothing", "external", 0) in status and ("Oops", "external", 0) in status
    assert graph.coverage.where("refs_total <> refs_exact + refs_inferred + refs_unresolved").isEmpty()


def test_questions(graph):
    assert names(graph.callers_of("pad", depth=3).rows) == {"clean", "render"}
    assert names(graph.callees_of("render").rows) == {"clean", "pad"}
    cut = graph.callers_of("pad", depth=3, limit=1)
    assert cut.truncated and cut.total == 2 and cut.rows.count() == 1
    assert "Square" in names(graph.impact_of("Base").rows)
    assert graph.find_paths("render", "pad").first().length == 1
    assert "Square" in names(graph.search("square"))
    assert graph.find_usage("clean", "call").count() == 1
    assert [r.name for r in graph.at_line("app/shapes.py", 13).collect()] == ["shapes", "Base", "side"]
    with pytest.raises(KeyError):
        graph.node("same")


def test_context_services_and_capabilities(graph):
    u = graph.find_usage("util.text.clean", "import").first()
    assert (u.context_before, u.context_line, u.context_after) == ("import util.text as tx", "from util.text import clean", "")
    assert graph.find_usage("Square", "call").first().context_after == "raise Oops()"
    assert {r["name"] for r in graph.services.collect()} >= {"root"}
    (py,) = graph.capabilities().where("lang = 'python'").collect()
    assert (py.level, py.level_unsupported, py.calls, py.inherits, py.dataflow) == ("L2", None, "true", "true", "true")


def test_store(spark, graph, tree, tmp_path):
    assert graph.verify(str(tree), str(tmp_path / "again"))
    again = LineageGraph(spark, str(tmp_path / "again"))
    assert build_digest(x=graph.nodes.repartition(7)) == build_digest(x=graph.nodes) != build_digest(x=graph.nodes.where("kind <> 'class'"))
    spark.createDataFrame([(S.SCHEMA_VERSION + 1, "")], "schema_version int, build_digest string").write.mode("overwrite").parquet(f"{again.path}/meta")
    with pytest.raises(S.SchemaMismatch):
        LineageGraph(spark, again.path)


def test_streams(spark, tree, tmp_path):
    seen = []
    watch(spark, str(tree), str(tmp_path / "live"), str(tmp_path / "cp"), None, lambda g: seen.append(g.digest)).awaitTermination()
    watch(spark, str(tree), str(tmp_path / "live"), str(tmp_path / "cp"), None, lambda g: seen.append(g.digest)).awaitTermination()
    assert len(seen) == 1  # nothing changed, so nothing was rebuilt
    e = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'a'")
    assert sorted(r.n for r in windowed(e, "ts", ["k"]).collect()) == [1, 2]
