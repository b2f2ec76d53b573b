"""Resolution, contracts, risks, impact, diffs, stack traces and ranked search on small tables."""

import pytest
from pyspark.sql import functions as F

from skein.operators import contracts as C
from skein.operators import impact as I
from skein.operators import resolve as R
from skein.operators import risks as K
from skein.operators import search as S

NODE = "id string, kind string, name string, parent_id string, dotted string, lang string, type_ref string, file_path string, start_line int, end_line int"
REF = "from_node string, kind string, name string, ref_text string, receiver string, target string, lang string, file_path string, start_line int, end_line int"


@pytest.fixture(scope="module")
def nodes(spark):
    n = lambda i, k, name, up, ref=None, lang="python": (i, k, name, up, i, lang, ref, "f.py", 1, 9)
    return spark.createDataFrame(
        [
            n("m", "module", "m", None), n("Base", "class", "Base", "m"), n("Base.save", "method", "save", "Base"), n("Base.size", "field", "size", "Base"),
            n("Sub", "class", "Sub", "m"), n("Sub.run", "method", "run", "Sub"), n("Sub.run.repo", "parameter", "repo", "Sub.run", "Store"),
            n("Sub.load", "method", "load", "Sub"), n("m2", "module", "m2", None), n("Store", "class", "Store", "m2"), n("Store.put", "method", "put", "Store"),
            n("Sub.store", "field", "store", "Sub", "Optional[Store]"), n("one", "function", "only", "m2"), n("t1", "function", "twin", "m"), n("t2", "function", "twin", "m2"),
            n("j", "function", "only_java", "m2", lang="java"), n("Iface", "interface", "Iface", "m2"), n("far", "function", "helper", "m2"), n("near", "function", "helper", "m"),
        ],
        NODE,
    )


def ref(kind, name, receiver=None, target=None, at="Sub.run", line=5):
    return (at, kind, name, f"{receiver}.{name}" if receiver else name, receiver, target, "python", "f.py", line, line)


def test_rungs(spark, nodes):
    rows = [ref("inherit", "Base", at="Sub"), ref("inherit", "Iface", target="Iface", at="Store"), ref("call", "save", "self"), ref("call", "load", "self"), ref("call", "put", "repo"), ref("call", "put", "self.store"),
            ref("call", "helper"), ref("call", "only", "x"), ref("call", "twin", "y"), ref("call", "only_java", "x"), ref("call", "gone"), ref("read", "size", "self"), ref("call", "there", target="one"), ref("call", "Store", target="Store"), ref("call", "exact", "z", line=7)]
    precise = spark.createDataFrame([("f.py", 7, "exact", "one")], "file_path string, start_line int, name string, dst string")
    out = R.resolve(spark.createDataFrame(rows, REF), nodes, precise)
    got = {r.ref_text: (r.status, r.step, r.dst, r.n_candidates) for r in out.collect()}
    assert got == {
        "Base": ("exact", "lexical", "Base", 1), "Iface": ("exact", "lexical", "Iface", 1), "self.save": ("exact", "self_receiver", "Base.save", 1), "self.load": ("exact", "self_receiver", "Sub.load", 1),
        "repo.put": ("exact", "declared_receiver_type", "Store.put", 1), "self.store.put": ("exact", "declared_receiver_type", "Store.put", 1), "helper": ("exact", "lexical", "near", 1),
        "x.only": ("inferred", "project_wide_name", "one", 1), "y.twin": ("ambiguous", "project_wide_name", None, 2), "x.only_java": ("external", None, None, 0), "gone": ("external", None, None, 0),
        "self.size": ("exact", "self_receiver", "Base.size", 1), "there": ("inferred", "import", "one", 1), "Store": ("inferred", "import", "Store", 1), "z.exact": ("exact", "precise_index", "one", 1),
    }
    assert next(r.candidates for r in out.where("status = 'ambiguous'").collect()) == ["t1", "t2"]
    edges = {(r.src, r.dst, r.kind, r.evidence_tier) for r in R.edges_of(out, nodes).collect()}
    assert {("Store", "Iface", "IMPLEMENTS", "fact"), ("Sub.run", "Store", "INSTANTIATES", "heuristic"), ("Sub", "Base", "INHERITS", "fact"), ("m", "Sub", "CONTAINS", "fact")} <= edges
    b = R.boundaries_of(out).first()
    assert (b.node_id, b.kind, b.candidates) == ("Sub.run", "dynamic_dispatch", ["t1", "t2"])
    c = R.coverage(out).first()
    assert (c.refs_total, c.refs_exact, c.refs_inferred, c.refs_unresolved, c.dataflow_status) == (15, 9, 3, 3, "computed")


def test_inheritance_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {(r.id, r.base, r.up) for r in R.bases(e).collect()} >= {("a", "b", 1), ("a", "c", 2)}


def test_param_binds_and_returns(spark):
    calls = spark.createDataFrame([("k", "f", "x.py", 20, 30)], "call string, callee string, file_path string, start_byte int, end_byte int")
    params = spark.createDataFrame([("p0", "f", "self", 0), ("p1", "f", "a", 1), ("p2", "f", "b", 2)], "id string, parent_id string, name string, position int")
    args = spark.createDataFrame([("k", 0, "v"), ("k", 1, "w"), ("k", 2, "surplus")], "call string, position int, src string")
    assert {(r.src, r.dst, r.kind) for r in R.param_binds(calls, args, params).collect()} == {("v", "p1", "PARAM_BINDS"), ("w", "p2", "PARAM_BINDS")}
    writes = spark.createDataFrame([("outer", "x.py", 0, 90), ("value", "x.py", 15, 31), ("other", "y.py", 0, 90)], "value string, file_path string, start_byte int, end_byte int")
    assert [(r.src, r.dst, r.kind) for r in R.returns(calls, writes).collect()] == [("f", "value", "RETURNS")]


def test_contracts(spark):
    schema = "from_node string, kind string, ref_text string, lang string, file_path string, start_line int, args array<struct<index int, name string, text string>>"
    rows = [
        ("h", "decorate", "app.post", "python", "a.py", 3, [(0, None, "'/orders/<id>'")]), ("c", "call", "requests.post", "python", "b.py", 4, [(0, None, '"https://x.example/orders/{id}?q=1"')]),
        ("v", "decorate", "app.route", "python", "a.py", 9, [(0, None, "'/all'"), (1, "methods", "['PUT']")]), ("n", "call", "requests.get", "python", "b.py", 6, [(0, "url", "'/named'")]),
        ("d", "call", "requests.get", "python", "b.py", 7, [(0, None, "'/api/' + name")]), ("e", "call", "os.getenv", "python", "b.py", 8, [(0, None, "'HOME_DIR'")]),
        ("u", "decorate", "weird.on", "python", "c.py", 1, [(0, None, "'/x/y'")]), ("z", "call", "my.requests.get", "python", "b.py", 9, [(0, None, "'/z'")]), ("j", "call", "requests.get", "java", "b.java", 9, [(0, None, "'/z'")]),
    ]
    refs = spark.createDataFrame(rows, schema)
    a = C.adapters(spark)
    nodes, edges, loose = C.detect(refs, a)
    name = {r.id: r["name"] for r in nodes.collect()}
    assert set(name.values()) == {"POST /orders/{*}", "PUT /all", "GET /named", "HOME_DIR", "GET /z"}
    assert {(r.src, name[r.dst], r.kind) for r in edges.collect()} == {("h", "POST /orders/{*}", "EXPOSES"), ("c", "POST /orders/{*}", "CONSUMES"), ("v", "PUT /all", "EXPOSES"), ("n", "GET /named", "CONSUMES"), ("e", "HOME_DIR", "CONSUMES"), ("z", "GET /z", "CONSUMES")}
    assert [(r.node_id, r.kind, r.detail) for r in loose.collect()] == [("d", "dynamic_contract_key", "http_route /api/")]
    assert [(r["name"], r.n) for r in C.unclaimed(refs, a).collect()] == [("weird.on", 1)]
    with pytest.raises(TypeError):
        C.adapters(spark, [("x", "python", "call", True, "topic", "exposes", None, 0, None)])


def test_risks(spark):
    nodes = spark.createDataFrame([("f", "app.f", "python", "function", 1), ("g", "app.g", "python", "function", 0), ("h", "app.h", "python", "function", 0), ("s", "app.asyncio.sleep", "python", "function", 0), ("t", "lib.requests.get", "python", "function", 0), ("i", "app.i", "python", "function", 1)], "id string, qualified_name string, lang string, kind string, flags int")
    calls = spark.createDataFrame([("f", "g", "fact"), ("g", "h", "heuristic"), ("f", "s", "fact"), ("s", "t", "fact"), ("h", "f", "fact")], "src string, dst string, evidence_tier string")
    external = spark.createDataFrame([("g", "time.sleep"), ("h", "x.Time::Sleep"), ("i", "asyncio.sleep"), ("i", "oversleep")], "src string, target string")
    rule = K.rules(spark)
    out = K.find(K.async_frames(nodes), calls, external, nodes, rule, spark.createDataFrame([("f",)], "id string"))
    got = {(r.frame, r.at, r.target, r.distance, r.tier, r.severity) for r in out.collect()}
    # at distance 2 a high risk rises by the entry point and drops by its evidence; at 3 it drops once more; the allowed call hides what is behind it
    assert got == {("f", "g", "time.sleep", 2, "heuristic", 2), ("f", "h", "x.Time::Sleep", 3, "heuristic", 1)}
    refs = spark.createDataFrame([("g", "decorate", "concurrency.Async")], "from_node string, kind string, ref_text string")
    assert {r.frame for r in K.async_frames(nodes, refs, ("Async",)).collect()} == {"f", "i", "g"}


DIFF = """diff --git a/app/x.py b/app/x.py
--- a/app/x.py
+++ b/app/x.py
@@ -1,3 +1,4 @@
 one
+two
 three
-four
+++ five
@@ -10,2 +11,3 @@ def f():
 ten

+twelve
--- a/gone.py
+++ /dev/null
@@ -1,1 +0,0 @@
-x
"""


def test_diffs(spark):
    d = spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "id int, text string")
    got = sorted((r.id, r.path, r.line, r.text) for r in I.diff_lines(d, "id", "text").collect())
    assert got == [(1, "app/x.py", 2, "two"), (1, "app/x.py", 4, "++ five"), (1, "app/x.py", 13, "twelve")]


SPANS = "id string, kind string, file_path string, start_line int, end_line int"


def test_line_impact(spark):
    n = spark.createDataFrame([("m", "module", "a.py", 1, 90), ("C", "class", "a.py", 2, 30), ("C.f", "method", "a.py", 5, 9), ("v", "variable", "a.py", 40, 40)], SPANS)
    e = spark.createDataFrame([("C.f", "k", "EXPOSES", "a.py", 4), ("C.f", "d", "DECORATES", "a.py", 3), ("m", "v", "READS", "a.py", 50)], "src string, dst string, kind string, file_path string, line int")
    lines = spark.createDataFrame([("a.py", x) for x in (2, 3, 4, 5, 7, 40, 50, 400)], "path string, line int")
    got = {r.line: (r.change, r.target) for r in I.retarget(lines, n, e).collect()}
    assert got == {2: ("type", "C"), 3: ("annotation", "C"), 4: ("contract_key", "C.f"), 5: ("signature", "C.f"), 7: ("body", "C.f"), 40: ("declaration", "v"), 50: ("body", "m"), 400: ("body", None)}


def test_stack_traces(spark):
    text = 'Traceback:\n  File "/srv/app/a.py", line 12, in main\n  File "/srv/app/a.py", line 7, in f\n  File "/usr/lib/x.py", line 3, in g\n  File "/srv/app/a.py", line 7, in f\nError'
    java = "at x.A.f(A.java:5)\nat x.B.g(B.java:9)"
    t = spark.createDataFrame([(1, text), (2, java), (3, None)], "id int, text string")
    files = spark.createDataFrame([("app/a.py",), ("lib/A.java",), ("src/A.java",)], "path string")
    n = spark.createDataFrame([("m", "module", "app/a.py", 1, 90), ("f", "function", "app/a.py", 6, 9), ("A.f", "method", "src/A.java", 4, 6)], SPANS)
    got = [(r.id, r.at, r.line, r.file, r.node, r.missing) for r in I.map_stacktrace(t, "id", "text", files, n).orderBy("id", "at", "file").collect()]
    assert got == [(1, 0, 7, "app/a.py", "f", False), (1, 1, 3, None, None, True), (1, 2, 12, "app/a.py", "m", False), (2, 0, 5, "lib/A.java", None, True), (2, 0, 5, "src/A.java", "A.f", False), (2, 1, 9, None, None, True)]


def test_weighted_search(spark):
    d = spark.createDataFrame([("a", "save", "shop.save", "stores an order", "(order)"), ("b", "order", "shop.order", None, "()"), ("c", "load", "shop.load", "save_order twice", "()"), ("d", "x", "y.z", "nothing", "")], "id string, name string, qualified_name string, docstring string, signature string")
    ix = S.index(d, "id", {"name": 10.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0})
    got = [r.id for r in S.ranked(ix, "order").orderBy("score", "id").collect()]
    assert got[0] == "b" and set(got) == {"a", "b", "c"}
    assert [r.id for r in S.ranked(ix, "save ord").orderBy("score", "id").collect()] == ["a", "c"]
    assert {r.id for r in S.ranked(ix, "save missing").collect()} == {"a", "c"}  # no row holds both: any of them counts
    assert [r.id for r in S.ranked(ix, "save_ord").collect()] == ["c"]  # joined terms are a phrase
    assert S.ranked(ix, "zzz").count() == 0 and S.ranked(ix, " -- ").count() == 0
    plain = {r.id: r.score for r in S.bm25(d.select("id", F.col("name").alias("t")), "id", "t", ["ord"], "or").collect()}
    alone = {r.id: r.score for r in S.ranked(S.index(d, "id", {"name": 1.0}), "ord").collect()}
    assert plain == alone


def test_search_guidance(spark):
    assert S.suggestions("howDoes the order_service handle timeouts") == ["howDoes", "order_service", "handle", "timeouts", "howDoes order_service"]
