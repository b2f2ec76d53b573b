"""Questions about the projected tables read what they touch, and settled tables are packed."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.operators.traverse import settle, shared_dir
from skein.sources import projection as P

SF = "/root/testdata/sf0.001"


def size(path: str) -> int:
    return sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*") if f.is_file())


def test_a_question_of_named_nodes_writes_no_store(spark, tmp_path):
    for f in Path(SF).iterdir():
        os.symlink(f, tmp_path / f.name)
    before = size(shared_dir(spark))
    assert P.stored(spark, str(tmp_path)).forward.of("c:7", "c:007", "x", "").count() == P.edges(spark, SF).where("src = 'c:7'").count() > 0
    assert size(shared_dir(spark)) - before < 20_000


@pytest.mark.parametrize("most", [64, 1 << 30, -1])
@pytest.mark.parametrize("end", ["src", "dst"])
def test_edges_near_many_nodes_are_those_of_the_whole_table(spark, monkeypatch, most, end):
    """By named keys, by a broadcast and by a shuffle of the frontier."""
    monkeypatch.setattr(P, "PUSHED", min(most, 64))
    monkeypatch.setattr(P, "FEW", most)
    every = settle(P.edges(spark, SF))
    keys = settle(every.where(F.pmod(F.crc32(F.col(end).cast("binary")), F.lit(3)) == 0).select(end).distinct().union(spark.createDataFrame([("c:007",), ("zz",), ("s:",), (None,)], "node string")))
    side = P.stored(spark, SF)
    got = (side.forward if end == "src" else side.backward).near(keys)
    want = every.join(keys, end, "left_semi").select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_settled_tables_are_packed(spark):
    before = size(shared_dir(spark))
    assert settle(spark.range(100_000).select((F.col("id") % 7).alias("a"), F.lit("the same long text in every row").alias("t"))).count() == 100_000
    assert size(shared_dir(spark)) - before < 400_000  # 5 MB as serialised rows


def test_candidates_are_dealt_by_reference_once(spark):
    from skein.operators import resolve as Z

    hits = spark.createDataFrame([(1, 5, 0, "call", 1, ["x"], "class"), (1, 1, 2, "call", 3, ["b", "a", "c"], "field"), (1, 1, 2, "call", 1, ["d"], "method"), (2, 5, 0, "read", 2, ["f", "e"], "class")], "ref long, rung int, level long, kind string, n long, ids array<string>, dst_kind string")
    best = Z._best(hits)
    assert sorted(map(tuple, best.collect())) == [(1, 1, 1, ["d"], "method"), (2, 5, 2, ["e", "f"], "class")]
    assert best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_points_ask_only_for_sizes_that_spans_have(spark):
    from skein.operators import intervals as V

    got = spark.range(1).select(V.around(F.lit(5), [0, 2]).alias("x"), F.size(V.blocks(F.lit(3), F.lit(12))).alias("n")).first()
    assert [tuple(b) for b in got.x] == [(0, 5), (2, 1)] and got.n == 4  # 3, 4-7, 8-11, 12


def test_an_index_for_one_question_holds_its_terms_only(spark):
    from skein.operators import search as R

    docs = spark.createDataFrame([(1, "web", "alpha beta-gamma"), (2, "beta", "gamma alpine"), (3, None, "delta")], "id long, source string, text string")
    weights = {"source": 5.0, "text": 1.0}
    for q in ("alp gam", "beta-gam", "zzz", ""):
        small = R.index(docs, "id", weights, q)
        assert sorted(map(tuple, R.ranked(small, q, "or").collect())) == sorted(map(tuple, R.ranked(R.index(docs, "id", weights), q, "or").collect()))
    assert {r.term for r in R.index(docs, "id", weights, "beta-gam").postings.collect()} == {"beta", "gamma"}


def test_risks_over_stored_edges_equal_those_over_a_table(spark):
    from skein.operators import risks as K

    frames = P.table(spark, SF, "customer").where("c_custkey < 20").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("frame"))
    named = P.nodes(spark, SF).where("id like 's:%'").select("id", F.col("name").alias("qualified_name"), F.lit(None).cast("string").alias("lang"))
    outside, none = spark.createDataFrame([], "src string, target string"), spark.createDataFrame([], "id string")
    rule = K.rules(spark, [("rule", None, 2, r["qualified_name"], False) for r in named.limit(3).collect()])
    a, b = (settle(K.find(frames, c, outside, named, rule, none, 2)) for c in (P.stored(spark, SF), P.edges(spark, SF).where("kind = 'CALLS'")))
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
