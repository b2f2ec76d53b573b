"""Walks and paths over an edge table.

``walk`` is a frontier loop: one join and one anti-join a level, each level cut from its lineage by files in the
shared folder, so a plan never holds more than one level and hubs are split by the adaptive planner.
``find_paths`` enumerates simple paths of bounded length that stop at the goal.

Edges come as a table or as a stored ``Adjacency``.  A table's edges are copied once for a walk, since every level reads them
again; a stored one is read where the frontier touches it, and nothing of it is written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .adjacency import Adjacency, Lookup

#: Waiting nodes whose edges are read along with those of the visited one.
AHEAD = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``setCheckpointDir``, or of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="skein-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, columns are packed and pruned, and the planner knows sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*work: Callable) -> list:
    """Results of jobs that do not need each other, run side by side."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


#: Rows of a frontier that are broadcast to the edges; longer ones are joined by shuffle.
FEW = 20_000


def chosen(edges: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    """The distinct edges of some kinds, written once, since every level of a walk reads them again."""
    return settle((edges.where(F.col("kind").isin(*kinds)) if kinds else edges).select("src", "dst", "kind").distinct())


def steps(edges: DataFrame, direction: str, kinds: tuple[str, ...] | None) -> DataFrame:
    """Edges as (at, next, kind, key) in walking direction; ``key`` orders edges as their identity does."""
    if direction not in ("forward", "backward"):
        raise ValueError(f"direction must be forward or backward, not {direction!r}")
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    key = F.concat_ws("|", "src", "dst", "kind")
    return edges.select(F.col(a).alias("at"), F.col(b).alias("next"), "kind", key.alias("key"))


def walk(edges: DataFrame | Adjacency, starts: DataFrame | list[str], direction: str = "forward", kinds: tuple[str, ...] | None = None, max_depth: int = 6) -> DataFrame:
    """Shortest-path tree from every row of ``starts(node)``, or of a few named nodes.

    Rows ``(start, node, depth, parent, kind, path, signature)``; ``path`` holds the nodes from the start, and
    ``signature`` the edge kinds.  Of several parents the one whose edge keys come first wins, which is
    discovery order.  Cycles end at nodes already seen by the same start.
    """
    store = edges.side(direction) if isinstance(edges, Adjacency) else None
    step = None if store else steps(chosen(edges, kinds), direction, kinds)
    named = not isinstance(starts, DataFrame)
    if named:
        spark = (store.table if store else edges).sparkSession
        starts = spark.createDataFrame([(x,) for x in starts], "node string")
    s = starts.select(F.col("node").cast("string").alias("start")).distinct()
    front = s.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("kind"), F.array("start").alias("path"), F.array().cast("array<string>").alias("signature"), F.array().cast("array<string>").alias("keys"))
    seen = front = front if named and store else settle(front)
    for depth in range(1, max_depth + 1):
        n, at = _touched(front, store)
        if not n:
            break
        out = steps(store.near(front.select("node"), (n, at), kinds), direction, kinds) if store else step
        near = F.broadcast(front) if n <= FEW else front
        new = near.join(out.withColumnRenamed("kind", "k"), near["node"] == out["at"]).select(
            "start", F.col("next").alias("node"), F.struct(F.concat("keys", F.array("key")).alias("keys"), F.col("node").alias("parent"), F.col("k").alias("kind"), F.concat("path", F.array("next")).alias("path"), F.concat("signature", F.array("k")).alias("signature")).alias("x"),
        )
        new = new.groupBy("start", "node").agg(F.min("x").alias("x")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = new.select("start", "node", F.lit(depth).alias("depth"), "x.parent", "x.kind", "x.path", "x.signature", "x.keys")
        # the last level is read by no other; of a stored graph it is left to the reader of the answer
        front = front if store and depth == max_depth else settle(front)
        seen = seen.unionByName(front)
    return seen.drop("keys")


def cut_off(edges: DataFrame | Adjacency, walked: DataFrame, direction: str, kinds: tuple[str, ...] | None, max_depth: int) -> DataFrame:
    """Where a walk of ``max_depth`` stopped though it could go on: ``(start, node, unseen)`` with the number of neighbours that it has not seen."""
    last = walked.where(F.col("depth") == max_depth).select("start", "node")
    out = steps(edges.side(direction).near(last.select("node"), kinds=kinds) if isinstance(edges, Adjacency) else edges, direction, kinds).select("at", "next").distinct()
    beyond = last.join(out, last["node"] == out["at"]).select("start", "node", "next")
    beyond = beyond.join(walked.select("start", F.col("node").alias("next")), ["start", "next"], "left_anti")
    return beyond.groupBy("start", "node").agg(F.count("*").alias("unseen"))


def _touched(front: DataFrame, store: Lookup | None) -> tuple[int, list[int]]:
    """Rows of a frontier, and the bins of a store that hold its edges."""
    return store.touched(front.select("node")) if store else (front.count(), [])


def find_paths(edges: DataFrame | Adjacency, start: str, goal: str, kinds: tuple[str, ...] | None = None, max_depth: int = 6, max_paths: int | None = 6) -> DataFrame:
    """Simple paths from ``start`` to ``goal`` as ``(rank, length, path, signature)``, shortest first.

    Parallel edges give one path per node sequence, the one with the smallest edge keys.  Both ends
    are pruned: only nodes that reach the goal within the depth left are extended.
    """
    stored = isinstance(edges, Adjacency)
    spark = (edges.forward.table if stored else edges).sparkSession
    edges = edges if stored else chosen(edges, kinds)
    reach = walk(edges, [goal], "backward", kinds, max_depth).select(F.col("node").alias("next"), F.col("depth").alias("left"))
    if stored:  # the walk's last level is not written, and is read three times below
        reach = settle(reach)
    step = steps(edges.backward.near(reach.select("next"), kinds=kinds) if stored else edges, "forward", kinds)
    step = settle(step.join(reach, "next").groupBy("at", "next", "left").agg(F.min(F.struct("key", "kind")).alias("e")))
    front = spark.createDataFrame([(start, [start], [], [])], "node string, path array<string>, signature array<string>, keys array<string>")
    done = None
    for depth in range(1, max_depth + 1):
        new = front.join(step, front["node"] == step["at"]).where(~F.array_contains("path", F.col("next")) & (F.col("left") + depth <= max_depth))
        new = settle(new.select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("signature", F.array("e.kind")).alias("signature"), F.concat("keys", F.array("e.key")).alias("keys")))
        hit = new.where(F.col("node") == goal)
        done = hit if done is None else done.union(hit)
        front = new.where(F.col("node") != goal)
        if front.isEmpty():
            break
    out = done.select(F.size("signature").alias("length"), "path", "signature", "keys")
    if max_paths is not None:
        out = out.orderBy("length", "keys").limit(max_paths)
    return out.select(F.row_number().over(Window.orderBy("length", F.concat_ws(",", "signature"), "keys")).alias("rank"), "length", "path", "signature")


def trace_flow(edges: DataFrame | Adjacency, start: str, kinds: tuple[str, ...], max_depth: int = 6, budget: int = 60) -> list[dict]:
    """Depth-first pre-order of the bounded neighbourhood of ``start``, as ``[{order, depth, node, kind, truncated}]``.

    The order depends on visiting one node after another.  Out-edges are read into the driver as the walk needs
    them, for the node visited and the next ``AHEAD`` waiting ones, in the order of their keys and at most as
    many unseen callees as the budget can still use, so the walk is exact however broad the graph is.
    """
    single = lambda df: steps(df, "forward", kinds).groupBy("at", "next").agg(F.min(F.struct("key", "kind")).alias("e"))
    step = None if isinstance(edges, Adjacency) else settle(single(edges))
    out_edges: dict[str, list] = {}
    out, seen, stack = [], set(), [(start, None, 0)]

    def fetch(nodes: list[str]) -> None:
        w = Window.partitionBy("at").orderBy("e.key")
        of = single(edges.forward.of(*nodes, kinds=kinds)) if step is None else step
        near = of.where(F.col("at").isin(nodes) & ~F.col("next").isin([*seen, nodes[0]]))
        rows = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= budget - len(out)).select("at", "nth", "next", "e.kind").collect()
        out_edges.update({n: [] for n in nodes})
        for r in sorted(rows, key=lambda r: (r["at"], r["nth"])):
            out_edges[r["at"]].append((r["next"], r["kind"]))

    while stack and len(out) < budget:
        node, kind, depth = stack.pop()
        if node in seen:
            continue
        if node not in out_edges:
            fetch([node, *dict.fromkeys(n for n, _, _ in reversed(stack[-AHEAD:]) if n not in seen and n not in out_edges and n != node)])
        seen.add(node)
        cut = depth == max_depth and any(n not in seen for n, _ in out_edges[node])
        out.append({"order": len(out), "depth": depth, "node": node, "kind": kind, "truncated": cut})
        if depth < max_depth:
            stack += [(n, k, depth + 1) for n, k in reversed(out_edges[node]) if n not in seen]
    return out
