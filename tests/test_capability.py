import subprocess

from skein.operators import capability as K
from skein.operators import metrics as M
from skein.sources.git import Provenance, provenance


def test_matrix(spark):
    nodes = spark.createDataFrame([("a", "class", "python"), ("b", "method", "python"), ("c", "class", "go"), ("d", "package", None)], "id string, kind string, lang string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "READS"), ("b", "a", "READS"), ("b", "a", "WRITES"), ("c", "a", "CONTAINS"), ("d", "a", "CONTAINS")], "src string, dst string, kind string")
    p = {r.lang: (r.nodes, r.edges) for r in K.presence(nodes, edges).collect()}
    assert p == {"python": ({"class": 1, "method": 1}, {"CALLS": 1, "READS": 2, "WRITES": 1}), "go": ({"class": 1}, {"CONTAINS": 1})}
    m = K.matrix(nodes, edges, {"python": "L2", "go": "L2", "java": "L1"}, {"python": ("class", "field"), "go": ("class",)})
    got = {r.lang: (r.level, r.level_unsupported, r.missing_nodes, r.calls, r.inherits, r.dataflow) for r in m.collect()}
    assert got == {
        "python": ("L2", None, ["field"], "true", "false", "true"),
        "go": ("L2", "L1", [], "false", "false", "false"),
        "java": ("L1", None, None, "untested", "untested", "untested"),
    }
    assert K.matrix_json(m) == K.matrix_json(m.repartition(5)) and K.matrix_json(m).endswith("}\n")
    assert [r.lang for r in K.below_floor(m, {"java": "L2", "go": "L1"}).collect()] == ["java"]
    assert K.matrix(nodes.limit(0), edges.limit(0), {"python": "L2"}).first().level_unsupported is None


def test_digest(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(30)], "a int, b string")
    assert K.digest(rows) == K.digest(rows.repartition(6).select("b", "a")) != K.digest(rows.where("a > 0"))


def test_provenance(tmp_path):
    assert provenance(str(tmp_path / "nowhere")) == Provenance()
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@example.org", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-b", "trunk")
    assert provenance(str(tmp_path)) == Provenance()  # nothing committed
    (tmp_path / "a").write_text("1")
    git("add", "a")
    git("commit", "-m", "a")
    head = git("rev-parse", "HEAD")
    (tmp_path / "new").write_text("not tracked")
    assert provenance(f"file://{tmp_path}") == Provenance(head, "trunk", False)
    (tmp_path / "a").write_text("2")
    git("checkout", "--detach")
    assert provenance(str(tmp_path)) == Provenance(head, None, True)


def test_token_impact(spark):
    answers = spark.createDataFrame([(1, "x" * 41), (2, "é" * 4), (3, "")], "answer int, body string")
    touched = spark.createDataFrame([(1, "n1", None), (1, "n2", None), (1, None, "b.py"), (1, None, "b.py"), (2, "gone", None)], "answer int, id string, path string")
    nodes = spark.createDataFrame([("n1", "a.py"), ("n2", "a.py")], "id string, file_path string")
    files = spark.createDataFrame([("a.py", 8001), ("b.py", 403)], "path string, size_bytes long")
    got = {tuple(r) for r in M.impact(answers, touched, nodes, files).collect()}
    assert got == {(1, 11, 2100, 2089), (2, 2, 1200, 1198), (3, 0, 1200, 1200)}


def test_report(spark):
    rows = [("2024-01-08 10:00:00", "walk", 14200, 420, 13780, 18, True), ("2024-01-09 10:00:00", "walk", 1000, 500, 500, 4, False), ("2024-01-01 00:00:00", "find", 100, 100, 0, 2, False)]
    inv = spark.createDataFrame(rows, "ts string, tool_name string, raw_tokens long, optimized_tokens long, tokens_saved long, duration_ms long, synced boolean").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    total, tools, sync = M.report(inv)
    assert total.first().calls == 3 and total.first().tokens_saved == 14280 and [r.tool_name for r in tools.collect()] == ["walk", "find"]
    assert tuple(sync.first()) == (3, 1, 2)
    week = M.report(inv, "7d", now="2024-01-09 12:00:00")[0].first()
    assert (week.calls, week.reduction, week.mean_ms) == (2, 93.9, 11.0)
    assert M.report(inv, "today", now="2024-01-09 12:00:00")[0].first().calls == 1
    empty = M.report(inv.limit(0))[0].first()
    assert (empty.calls, empty.raw_tokens, empty.reduction, empty.usd) == (0, 0, 0.0, 0.0)
    assert "Synced: 1 of 3 (2 pending)" in M.report_text(inv, "shop") and "walk" in M.report_text(inv, "shop")
