"""What a graph holds per language, and whether that bears out the level the language claims."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels, and the edge kinds of which one at least corroborates each: fixed values.
LEVELS = ("L0", "L1", "L2")
EVIDENCE = {"L1": ("CALLS", "IMPORTS"), "L2": ("READS", "WRITES", "PARAM_BINDS", "RETURNS")}
#: What a capability needs of the edges found, all of it.
NEEDS = {"calls": ("CALLS",), "inherits": ("INHERITS",), "implements": ("IMPLEMENTS",), "dataflow": ("READS", "WRITES"), "contracts": ("EXPOSES",)}


def presence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(lang, nodes, edges)``: the counted kinds of a language; an edge is of its source's language.  Nodes without one are left out."""
    n = nodes.where("lang is not null")
    e = edges.join(n.select(F.col("id").alias("src"), "lang"), "src").select("lang", "kind", F.lit("edges").alias("what"))
    each = n.select("lang", "kind", F.lit("nodes").alias("what")).union(e).groupBy("lang", "what", "kind").agg(F.count("*").alias("n"))
    # as many rows as languages have kinds, whatever the graph's size
    kinds = lambda w: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == w, F.struct("kind", "n")))))
    return each.groupBy("lang").agg(kinds("nodes").alias("nodes"), kinds("edges").alias("edges"))


def _shortfall(claim: Column, found: Column) -> Column:
    """The first level up to the claim that no edge kind bears out; null if none."""
    out = F.lit(None).cast("string")
    for level in reversed(LEVELS[1:]):
        bare = (claim >= level) & ~F.arrays_overlap(found, F.array(*map(F.lit, EVIDENCE[level])))
        out = F.when(bare, F.lit(level)).otherwise(out)
    return out


def matrix(nodes: DataFrame, edges: DataFrame, claims: Mapping[str, str], expected: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per claimed or seen language: claimed level, the level not borne out, missing node kinds, and each capability.

    A capability is ``true`` or ``false`` where the language has been seen, ``untested`` where it has not.
    ``expected`` names the node kinds that a language must show.
    """
    spark = nodes.sparkSession
    told = spark.createDataFrame([(k, v, sorted((expected or {}).get(k, ()))) for k, v in sorted(claims.items())], "lang string, level string, must array<string>")
    got = presence(nodes, edges).join(told, "lang", "full")
    level, seen = F.coalesce("level", F.lit("L0")), F.col("nodes").isNotNull()
    found = F.map_keys(F.coalesce("edges", F.expr("map()").cast("map<string,bigint>")))
    have = lambda kinds: F.when(~seen, "untested").otherwise((F.size(F.array_except(F.array(*map(F.lit, kinds)), found)) == 0).cast("string"))
    missing = F.when(seen, F.array_except(F.coalesce("must", F.array().cast("array<string>")), F.map_keys("nodes")))
    return got.select("lang", level.alias("level"), F.when(seen, _shortfall(level, found)).alias("level_unsupported"), missing.alias("missing_nodes"), *[have(k).alias(c) for c, k in NEEDS.items()])


def matrix_json(rows: DataFrame) -> str:
    """The matrix (a row a language) as JSON with sorted keys, the same for the same rows."""
    return json.dumps({r["lang"]: r.asDict() for r in rows.collect()}, indent=2, sort_keys=True) + "\n"


def below_floor(rows: DataFrame, floors: Mapping[str, str]) -> DataFrame:
    """Languages of ``matrix`` whose claimed level is under their floor."""
    want = rows.sparkSession.createDataFrame(sorted(floors.items()), "lang string, floor string")
    return rows.join(want, "lang").where("level < floor").select("lang", "level", "floor")


def digest(rows: DataFrame) -> str:
    """One hash of a table of rules, adapters or kinds, whatever its order: the hash of its sorted row hashes.  Such tables are small."""
    h = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    return h.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256)).first()[0]
