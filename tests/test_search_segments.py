"""The stored search index: what its segments say after changes, against an index built anew."""

import random

from skein.graph import LineageGraph
from skein.operators import search

WEIGHTS = {"name": 10.0, "doc": 1.0}
SCHEMA = "id string, name string, doc string"


def docs(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


def ask(ix, *questions):
    return [sorted((r.id, r.hits, r.score) for r in search.ranked(ix, q, m).collect()) for q in questions for m in ("and", "or")]


QUESTIONS = ("save", "sav order", "load_all", "zeta")


def test_changed_segments_equal_a_new_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "MOST", 3)
    g = random.Random(4)
    word = lambda: g.choice(["save", "saver", "order", "load_all", "load all", "all", "x"])
    rows = {f"n{i}": (word(), None if i % 7 == 0 else f"{word()} {word()}") for i in range(40)}
    seg = search.Segments.build(docs(spark, rows), "id", WEIGHTS, str(tmp_path / "s"))
    assert ask(seg.index(), *QUESTIONS) == ask(search.index(docs(spark, rows), "id", WEIGHTS), *QUESTIONS)
    sizes = []
    for step in range(4):
        old = dict(rows)
        for _ in range(4):
            rows.pop(g.choice(sorted(rows)))
            rows[g.choice(sorted(rows))] = (word(), word())
        rows[f"new{step}"] = ("zeta order", None)
        first = seg
        seg = seg.change(docs(spark, old), docs(spark, rows), "id")
        sizes.append(len(seg.names))
        assert ask(seg.index(), *QUESTIONS) == ask(search.index(docs(spark, rows), "id", WEIGHTS), *QUESTIONS)
        # a reader of the older list still sees the older rows
        assert seg.index().stats.first().rows == len(rows) and first.index().stats.first().rows == len(old)
    assert sizes == [2, 3, 1, 2]


def test_a_question_reads_only_the_row_groups_of_its_terms(spark, tmp_path):
    seg = search.Segments.build(spark.range(3000).selectExpr("cast(id as string) as id", "concat('w', id % 500) as name", "'common words' as doc"), "id", WEIGHTS, str(tmp_path / "s"))
    plan = search.ranked(seg.index(), "w17", "and")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), GreaterThanOrEqual(term,w17), LessThan(term,w18)" in plan and "names" not in plan


def test_graph_searches_its_stored_index(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "a.py").write_text('def save_order(x):\n    """Keep it."""\n    return x\n')
    g = LineageGraph.build(spark, str(root), str(tmp_path / "g"))
    assert [r.name for r in g.search("save order").collect()] == ["save_order"]
    (root / "b.py").write_text("def save_more():\n    pass\n")
    (root / "a.py").write_text("def other():\n    pass\n")
    new = g.update(str(root))
    assert [r.name for r in new.search("save").collect()] == ["save_more"] and new.search("keep").count() == 0
    assert [r.name for r in g.search("save").collect()] == ["save_order"]
    assert len(new.found.names) == 2 and {r.name for r in new.explore("where is other").collect()} == {"other"}
