"""Points in intervals against brute force; what is joined stays near linear."""

import random

from pyspark.sql import functions as F

from skein.operators.impact import innermost
from skein.operators.intervals import LEVELS, blocks, stab


def test_every_pair_meets_once(spark):
    g = random.Random(3)
    top = 1 << (LEVELS - 1)
    near = [0, 1, 2, 3, 7, 8, 100, 255, 256, top - 1, top, 3 * top + 5]
    spans = [(f"f{g.randrange(3)}", i, *sorted((g.choice(near), g.choice(near)))) for i in range(80)] + [("f0", 900, 5, 4), ("f0", 901, -3, 7), (None, 902, 0, 9)]
    spans += [(f"f{g.randrange(3)}", 100 + i, *sorted((g.randrange(300), g.randrange(300)))) for i in range(80)]
    points = [(f"f{g.randrange(3)}", 1000 + i, g.choice([*near, g.randrange(300)])) for i in range(200)] + [("f0", 2000, None), ("f0", 2001, -1)]
    got = stab(spark.createDataFrame(points, "f string, p int, at int"), spark.createDataFrame(spans, "f string, s int, lo int, hi int"), ["f"], "at", "lo", "hi").collect()
    want = sorted((p, s) for f, p, at in points for h, s, lo, hi in spans if f == h and at is not None and 0 <= lo <= at <= hi)
    assert sorted((r.p, r.s) for r in got) == want


def test_spans_are_few_blocks(spark):
    n = spark.range(1, 200_000, 977).select(F.size(blocks(F.lit(3).cast("long"), F.col("id"))).alias("n")).agg(F.max("n")).first()[0]
    assert n <= 2 * LEVELS


def test_one_large_file_does_not_join_all_lines_with_all_symbols(spark):
    """40,000 lines and as many flat symbols in one file: pairs that are made are those that hold."""
    lines = spark.range(40_000).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line"))
    nodes = spark.range(40_000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("method").alias("kind"), F.lit("f").alias("file_path"), F.col("id").cast("int").alias("start_line"), F.col("id").cast("int").alias("end_line"))
    out = innermost(lines, nodes)
    assert out.where("node = concat('n', line)").count() == 40_000
    empty = innermost(lines.limit(1), nodes.limit(0)).first()
    assert (empty.path, empty.node, empty.node_kind) == ("f", None, None)
