"""Walks and paths against plain Python on random graphs; scalar forms; the contract of the entry module."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from skein import schema
from skein.functions import text as X
from skein.operators.search import bm25
from skein.operators.traverse import find_paths, trace_flow, walk

KINDS = ("CALLS", "READS")


def graph(spark, seed):
    g = random.Random(seed)
    rows = sorted({(g.choice("abcdefg"), g.choice("abcdefg"), g.choice(KINDS)) for _ in range(g.randint(6, 14))})
    return rows, spark.createDataFrame(rows, "src string, dst string, kind string")


@pytest.mark.parametrize("seed", range(4))
def test_walk_is_breadth_first(spark, seed):
    rows, e = graph(spark, seed)
    seen, queue = {"a": (0, ("a",))}, deque(["a"])
    while queue:
        at = queue.popleft()
        d, path = seen[at]
        for s, t, _ in rows:
            if s == at and t not in seen and d < 4:
                seen[t] = (d + 1, (*path, t))
                queue.append(t)
    got = {r.node: (r.depth, tuple(r.path)) for r in walk(e, spark.createDataFrame([("a",)], "node string"), max_depth=4).collect()}
    assert got == seen


@pytest.mark.parametrize("seed", range(3))
def test_find_paths_enumerates_simple_paths(spark, seed):
    rows, e = graph(spark, seed)
    want, stack = set(), [("a",)]
    while stack:
        p = stack.pop()
        for s, t, _ in rows:
            if s == p[-1] and t not in p and len(p) <= 4:
                want.add((*p, t)) if t == "g" else stack.append((*p, t))
    got = [tuple(r.path) for r in find_paths(e, "a", "g", max_depth=4, max_paths=None).orderBy("rank").collect()]
    assert set(got) == want and len(got) == len(want) and [len(p) for p in got] == sorted(len(p) for p in got)


def test_walk_ends_on_cycles_and_refuses_other_directions(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "a", "CALLS")], "src string, dst string, kind string")
    assert walk(e, spark.createDataFrame([("a",)], "node string")).count() == 2
    with pytest.raises(ValueError):
        walk(e, spark.createDataFrame([("a",)], "node string"), "sideways")


def test_trace_flow_is_pre_order(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("a", "d", "CALLS"), ("d", "c", "CALLS")], "src string, dst string, kind string")
    assert [r["node"] for r in trace_flow(e, "a", ("CALLS",))] == ["a", "b", "c", "d"]


def test_trace_flow_goes_deep_first_however_broad(spark):
    """A start with more callees than any bound on breadth, held against a plain walk over all edges."""
    rows = [("a", f"b{i:03d}", "CALLS") for i in range(400)] + [(f"b{i:03d}", f"c{i}{j}", k) for i in range(40) for j in range(3) for k in KINDS] + [("c00", "a", "CALLS"), ("c00", "d", "READS"), ("c01", "b001", "CALLS")]
    e = spark.createDataFrame(rows, "src string, dst string, kind string")
    for depth in (1, 2, 3):
        want, seen, stack = [], set(), [("a", None, 0)]
        while stack and len(want) < 30:
            node, kind, at = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            next_ = sorted((r for r in rows if r[0] == node), key="|".join)
            want.append({"order": len(want), "depth": at, "node": node, "kind": kind, "truncated": at == depth and any(r[1] not in seen for r in next_)})
            if at < depth:
                stack += [(r[1], r[2], at + 1) for r in reversed(next_) if r[1] not in seen]
        assert trace_flow(e, "a", KINDS, depth, 30) == want


def test_scalar_forms(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(X.normalise_http(F.lit("post"), F.lit('"https://h.example/a//{id}/:x/<y>/?q=1#f"'))) == "POST /a/{*}/{*}/{*}"
    assert pick(X.detect_intent(F.lit("show the callers"))) == "callers" and pick(X.detect_intent(F.lit("showroom"))) == "search"
    assert pick(X.flag_names(F.lit(257))) == ["ASYNC", "ENTRY_POINT"]
    assert tuple(pick(X.frame(F.lit('  File "a/b.py", line 12, in f')))) == ("a/b.py", 12)
    assert tuple(pick(X.frame(F.lit("at x.Y.z(Y.java:7)")))) == ("Y.java", 7) and pick(X.frame(F.lit("nothing"))) is None
    assert pick(X.elide(F.lit("\n".join("l" * 70)))).count("\n") == 60
    assert pick(X.severity(F.lit(3), F.lit(3), F.lit(True), F.lit("fact"))) == 3 and pick(X.severity(F.lit(0), F.lit(3), F.lit(False), F.lit("fact"))) == 0


def test_search_modes(spark):
    d = spark.createDataFrame([(1, "save order"), (2, "save"), (3, None)], "id long, text string")
    assert [r.id for r in bm25(d, "id", "text", ["sav", "ord"], "and").collect()] == [1]
    assert sorted(r.id for r in bm25(d, "id", "text", ["sav", "ord"], "or").collect()) == [1, 2]


def test_conform(spark):
    df = schema.conform(spark.createDataFrame([("a", 1)], "id string, extra int"), "nodes")
    assert df.schema == schema.struct("nodes")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
