"""References to edges, without ever picking arbitrarily.

Six rungs, the first that holds a candidate wins: a member of the receiver's own type (``self``), the lexical scopes
from inside out, members of the declared or constructed type of a receiver, imported names, a precise index (SCIP),
and the only symbol of that name in the same language.  Within a rung the nearest level wins.  Inheritance is
resolved first, since scopes and members look through the bases of a class.  Several symbols on the winning level
give no edge but an ``ambiguous`` row.  Candidates of a name are counted before the join and at most ``KEPT`` ids are
kept for the report, so a name that thousands of symbols share costs one row.

``affected`` names the references that a change of symbols may resolve in another way; the others keep what they have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import stab
from .traverse import settle, together

#: Edge kinds by reference kind: fixed values.
EDGE_OF = {"call": "CALLS", "import": "IMPORTS", "inherit": "INHERITS", "implement": "IMPLEMENTS", "decorate": "DECORATES", "type": "HAS_TYPE", "instantiate": "INSTANTIATES", "throw": "THROWS", "read": "READS", "write": "WRITES"}
_TYPES = ("class", "interface", "enum", "struct", "trait", "type_alias")
_VALUES = ("property", "field", "parameter", "variable", "constant", "enum_member")
#: Kinds that a reference may mean; where none of its candidates is of these, all count.
SYMBOL_FOR = {
    "call": ("function", "method", "constructor", "property", *_TYPES), "decorate": ("function", "method", "annotation", *_TYPES), "inherit": _TYPES, "implement": _TYPES, "type": _TYPES,
    "throw": _TYPES, "instantiate": _TYPES, "read": _VALUES, "write": _VALUES, "import": ("module", "package", "function", *_TYPES, *_VALUES),
}
#: Candidate ids that a report holds at most, and up to how many of them a boundary is noted.
KEPT, NOTED = 16, 8
#: Rows of a looked-up table that are broadcast.
BROADCAST = 400_000
FIRST = ("inherit", "implement", "import")
RUNGS = ("self_receiver", "lexical", "declared_receiver_type", "import", "precise_index", "project_wide_name")


def _allowed() -> Column:
    return F.create_map(*[x for k in sorted(SYMBOL_FOR) for x in (F.lit(k), F.array(*map(F.lit, SYMBOL_FOR[k])))])


def _held(nodes: DataFrame, *keys: str) -> DataFrame:
    """One row per key and symbol kind: how many symbols, and the smallest ``KEPT`` ids of them.

    Counts are pre-aggregated, and the window keeps its first rows before they are shuffled, so a name that very many symbols
    share does not bring them together in one task.
    """
    n = nodes.select(*keys, "kind", "id").distinct()
    first = n.withColumn("nth", F.row_number().over(W.partitionBy(*keys, "kind").orderBy("id"))).where(F.col("nth") <= KEPT)
    first = first.groupBy(*keys, "kind").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    many = n.groupBy(*keys, "kind").agg(F.count("*").alias("n"))
    return many.join(first, [*keys, "kind"]).withColumnRenamed("kind", "dst_kind")


def ancestors(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Containers of every symbol, or of those ``of(id)``, itself first: ``(id, scope, depth)``, however deep; a cycle ends where a container was seen before."""
    up = settle(nodes.where("parent_id is not null").select(F.col("id").alias("scope"), "parent_id").distinct())
    level = settle((nodes if of is None else of).select("id", F.col("id").alias("scope"), F.lit(0).alias("depth")).distinct())
    out, k = level, 0
    while True:
        k += 1
        level = level.join(up, "scope").select("id", F.col("parent_id").alias("scope"), F.lit(k).alias("depth"))
        level = settle(level.join(out.select("id", "scope"), ["id", "scope"], "left_anti"))
        if level.isEmpty():
            return out
        out = out.union(level)


def bases(inherits: DataFrame) -> DataFrame:
    """All bases of every type, nearest first: ``(id, base, up)``, however long the chain; cycles end where a base was seen before."""
    seen = level = settle(inherits.select(F.col("src").alias("id"), F.col("dst").alias("base"), F.lit(1).alias("up")).where("id <> base").distinct())
    step = level.select(F.col("id").alias("base"), F.col("base").alias("next"))
    k = 1
    while not level.isEmpty():
        k += 1
        level = level.join(step, "base").select("id", F.col("next").alias("base")).where("id <> base").distinct().join(seen, ["id", "base"], "left_anti")
        level = settle(level.select("id", "base", F.lit(k).alias("up")))
        seen = seen.union(level)
    return seen


def _best(hits: DataFrame) -> DataFrame:
    """Per reference the candidates of the first rung and nearest level; those of a fitting kind, or else all of them.

    Hits are dealt by reference once; every grouping below finds them in place.
    """
    fit = F.array_contains(F.try_element_at(_allowed(), F.col("kind")), F.col("dst_kind"))
    h = hits.repartition("ref").groupBy("ref", "kind", "rung", "level", "dst_kind").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    h = h.withColumn("fit", F.coalesce(fit, F.lit(False))).groupBy("ref", "rung", "level").agg(F.collect_list(F.struct("dst_kind", "n", "ids", "fit")).alias("x"))
    h = h.groupBy("ref").agg(F.min(F.struct("rung", "level", "x")).alias("h")).select("ref", "h.rung", "h.x")
    h = h.withColumn("x", F.when(F.exists("x", lambda c: c["fit"]), F.filter("x", lambda c: c["fit"])).otherwise(F.col("x")))
    n = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + F.greatest(c["n"], F.size(c["ids"]).cast("long")))
    return h.select("ref", "rung", n.alias("n"), F.slice(F.array_sort(F.flatten("x.ids")), 1, KEPT).alias("ids"), F.array_min("x.dst_kind").alias("dst_kind"))


_OPTIONAL = (("target", "string"), ("receiver", "string"), ("start_byte", "int"), ("end_byte", "int"), ("lang", "string"))
#: What makes two observations the same reference.
AT = ("file_path", "from_node", "kind", "ref_text", "start_line", "end_line", "start_byte", "end_byte")


def _have(df: DataFrame, *names: tuple[str, str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in names if c not in df.columns])


def _keyed(refs: DataFrame) -> DataFrame:
    """One row per reference; arguments that several observations hold are united."""
    r = _have(refs, *_OPTIONAL)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) if c == "args" else F.min(c)
    return r.groupBy(*AT).agg(*[united(c).alias(c) for c in r.columns if c not in AT])


def _numbered(r: DataFrame) -> DataFrame:
    """References at rest, each with a number ``ref`` that joins carry in place of what identifies it."""
    return settle(r.withColumn("ref", F.monotonically_increasing_id()))


def _few(df: DataFrame) -> DataFrame:
    """A table at rest, broadcast if it has few rows, so that what looks it up is not shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _known(nodes: DataFrame) -> DataFrame:
    return _have(nodes, ("dotted", "string"), ("lang", "string"), ("type_ref", "string"))


def _tail(c: Column) -> Column:
    """The last name of a type reference."""
    return F.regexp_extract(c, r"([\w$]+)\W*$", 1)


def _bare(receiver: Column) -> Column:
    return F.regexp_replace(receiver, r"^(self|this|cls)\.", "")


def _tables(nodes: DataFrame, r: DataFrame) -> dict[str, DataFrame]:
    """What the rungs look up, written once and read by every pass; of members and names only what ``r`` names."""
    named, full = nodes.where("name is not null"), nodes.where("dotted is not null")
    # most tables of symbols hold many names that no reference has
    named = named.join(_few(settle(r.select("name").distinct())), "name", "left_semi")
    full = full.join(r.where("target is not null").select(F.col("target").alias("dotted")).distinct(), "dotted", "left_semi")
    language = F.coalesce("lang", F.lit("")).alias("lang")
    types = nodes.where(F.col("kind").isin(*_TYPES))
    members, dotted, anywhere, holders = together(
        lambda: settle(_held(named.where("parent_id is not null"), "parent_id", "name").withColumnRenamed("parent_id", "holder")),
        lambda: settle(_held(full, "dotted").withColumnRenamed("dotted", "target")),
        lambda: settle(_held(named.where("kind <> 'parameter'").select("id", "kind", "name", language), "name", "lang")),
        lambda: settle(types.select(F.col("id").alias("holder")).distinct()),
    )
    return {
        "members": _few(members),
        "dotted": _few(dotted),
        "anywhere": _few(anywhere),
        "types": holders,
        "named": types.groupBy(F.col("name").alias("type_name"), F.col("lang").alias("type_lang")).agg(F.min("id").alias("holder"), F.countDistinct("id").alias("k")).where("k = 1").drop("k"),
        "hint": nodes.where("type_ref is not null").select(F.col("parent_id").alias("holder"), F.col("name").alias("receiver"), _tail(F.col("type_ref")).alias("type_name")).distinct(),
    }


def _inherits(r: DataFrame, done: DataFrame) -> DataFrame:
    """``(src, dst)`` of the references to bases that have one answer."""
    return r.where("kind in ('inherit', 'implement')").join(done.where("n = 1"), "ref").select(F.col("from_node").alias("src"), F.col("ids")[0].alias("dst"))


def resolve(refs: DataFrame, nodes: DataFrame, precise: DataFrame | None = None, inherits: DataFrame | None = None) -> DataFrame:
    """``refs`` with ``status`` (exact, inferred, ambiguous, external), ``step``, ``dst``, ``dst_kind``, ``candidates``, ``n_candidates``, ``reason``, ``late``.

    ``refs`` needs ``from_node, kind, name, ref_text, file_path, start_line, end_line``; ``target`` (imported name), ``receiver``,
    ``start_byte``, ``end_byte`` and ``lang`` may be missing.  ``nodes`` needs ``id, kind, name, parent_id``; ``dotted, lang, type_ref`` may be
    missing.  ``precise(file_path, at, dst)`` are answers of a precise index by the byte of a name (or by ``start_line, name``); a null ``dst`` says external.
    ``inherits(src, dst)`` are bases known beforehand, when ``refs`` are some of a graph's.  ``late`` marks a base or import that was only
    found through the bases of another.
    """
    nodes, r = _known(nodes), _numbered(_keyed(refs))
    look, scopes = together(lambda: _tables(nodes, r), lambda: ancestors(nodes, r.select(F.col("from_node").alias("id"))))
    first = r.where(F.col("kind").isin(*FIRST))
    done = settle(_pass(first, look, scopes, None, precise, nodes))
    found = _inherits(first, done)
    own = bases(found if inherits is None else found.union(inherits))
    none = own.isEmpty()
    best = done.union(settle(_pass(r.where(~F.col("kind").isin(*FIRST)), look, scopes, None if none else own, precise, nodes))).withColumn("late", F.lit(False))
    # a base that is a member of another base is found once the first bases are known
    again = settle(first.join(done, "ref", "left_anti"))
    if not none and not again.isEmpty():
        best = best.union(settle(_pass(again, look, scopes, own, precise, nodes)).withColumn("late", F.lit(True)))
    one = F.col("n") == 1
    rung = F.col("rung")
    status = F.when(rung.isNull() | (F.size("ids") == 0), "external").when(~one, "ambiguous").when(rung.isin(0, 1, 2, 4), "exact").otherwise("inferred")
    step = F.get(F.array(*map(F.lit, RUNGS)), rung)
    out = r.join(best, "ref", "left").withColumn("status", status)
    return out.select(
        *refs.columns, "status", F.when(F.col("status") != "external", step).alias("step"), F.when(one, F.get("ids", F.lit(0))).alias("dst"), F.when(one, F.col("dst_kind")).alias("dst_kind"),
        F.when(F.col("status") == "ambiguous", F.col("ids")).alias("candidates"), F.when(F.col("status") == "external", 0).otherwise(F.col("n")).cast("int").alias("n_candidates"),
        F.when(F.col("status") == "ambiguous", F.concat(F.col("n").cast("string"), F.lit(" candidates"))).when(F.col("status") == "external", "no symbol of this project").alias("reason"), F.coalesce("late", F.lit(False)).alias("late"),
    )


#: What of a symbol other symbols' references may depend on.
SEEN = ("id", "kind", "name", "parent_id", "dotted", "lang", "type_ref")


def affected(old: DataFrame, kept: DataFrame, new: DataFrame, old_nodes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(again, inherits)`` after a change: the rows of ``kept`` to resolve anew along with ``new``, and the bases that stay known.

    ``old`` are all references as they were resolved, ``kept`` those of unchanged files, ``new`` the observed ones of changed files; ``old_nodes`` and
    ``nodes`` the symbols before and after.  A reference depends on the symbols of its name, on its imported name, on the variable that is its
    receiver and that variable's type, and on the bases of the types around it or of its receiver; one that none of the changed symbols meets
    keeps its answer.
    """
    old_nodes, nodes = _known(old_nodes).select(*SEEN), _known(nodes).select(*SEEN)
    delta = settle(old_nodes.exceptAll(nodes).union(nodes.exceptAll(old_nodes)).distinct())
    both = old_nodes.union(nodes)
    hints = both.where("type_ref is not null").select("name", _tail(F.col("type_ref")).alias("type_name")).distinct()

    def meets(refs: DataFrame, said: DataFrame, receivers: DataFrame) -> DataFrame:
        """Rows of ``refs`` with a name or receiver among the given ones, or an imported name of a changed symbol."""
        some = lambda df, c: df.select(F.col(c).alias("_k")).where("_k is not null").distinct()
        keyed = refs.withColumns({"_name": F.col("name"), "_target": F.col("target"), "_receiver": _bare(F.col("receiver"))})
        for column, keys in (("_name", said), ("_target", some(delta, "dotted")), ("_receiver", receivers)):
            keyed = keyed.join(some(keys, keys.columns[0]).withColumn("_hit", F.lit(True)), F.col(column) == F.col("_k"), "left").drop("_k").withColumn(column, F.col("_hit")).drop("_hit")
        return keyed.where("_name or _target or _receiver").drop("_name", "_target", "_receiver")

    of_types = lambda types: hints.join(types.select(F.col("name").alias("type_name")).distinct(), "type_name", "left_semi").select("name")
    changed = delta.where(F.col("kind").isin(*_TYPES))
    held = settle(meets(kept, delta.select("name"), delta.where("type_ref is not null").select("name").union(of_types(changed))))
    # bases, as they are after the change
    early_of = lambda df: df.where("kind in ('inherit', 'implement') and dst is not null and not late")
    early = early_of(kept)
    stays = settle(early.join(held.select(*AT).distinct(), [early[c].eqNullSafe(held[c]) for c in AT], "left_anti").select(F.col("from_node").alias("src"), "dst"))
    first = _numbered(_keyed(held.select(*new.columns).union(new).where(F.col("kind").isin(*FIRST))))
    look, scopes = together(lambda: _tables(nodes, first), lambda: ancestors(nodes, first.select(F.col("from_node").alias("id"))))
    done = settle(_pass(first, look, scopes, None, None, nodes))
    after, before = together(lambda: bases(stays.union(_inherits(first, done))), lambda: bases(early_of(old).select(F.col("from_node").alias("src"), "dst")))
    moved = settle(before.exceptAll(after).union(after.exceptAll(before)).select("id").distinct())
    if not moved.isEmpty():
        inside = level = moved
        below = both.where("parent_id is not null").select(F.col("parent_id").alias("id"), F.col("id").alias("next")).distinct()
        while not level.isEmpty():
            level = settle(level.join(below, "id").select(F.col("next").alias("id")).distinct().join(inside, "id", "left_anti"))
            inside = inside.union(level)
        types = both.join(moved, "id", "left_semi")
        more = kept.join(inside.select(F.col("id").alias("from_node")), "from_node", "left_semi").select(*kept.columns)
        held = settle(held.union(more).union(meets(kept, delta.select("name").limit(0), of_types(types))).dropDuplicates(list(AT)))
        early = early.join(held.select(*AT), [early[c].eqNullSafe(held[c]) for c in AT], "left_anti")
        stays = settle(early.select(F.col("from_node").alias("src"), "dst"))
    return held, stays


def _pass(r: DataFrame, look: dict[str, DataFrame], scopes: DataFrame, own: DataFrame | None, precise: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Rows ``(ref, rung, n, ids, dst_kind)`` of the references that any rung answers."""
    hit = lambda df, rung, level: df.select("ref", F.lit(rung).alias("rung"), level.cast("long").alias("level"), "kind", "n", "ids", "dst_kind")
    members = look["members"]
    selfish = F.coalesce(F.col("receiver").isin("self", "this", "cls"), F.lit(False))
    plain = F.col("receiver").isNull()

    def through_bases(held: DataFrame) -> DataFrame:
        """Rows (.., holder, level) with the bases of each holder behind it."""
        held = held.withColumn("up", F.lit(0))
        if own is None:
            return held
        more = held.drop("up").join(own.withColumnRenamed("id", "holder"), "holder").drop("holder").withColumnRenamed("base", "holder")
        return held.unionByName(more)

    scoped = scopes.select(F.col("id").alias("from_node"), F.col("scope").alias("holder"), "depth")
    cols = ["ref", "kind", "name", "holder", "depth"]
    enclosing = r.where(selfish).join(scoped, "from_node").join(look["types"], "holder")
    nearest = enclosing.groupBy("ref", "kind", "name").agg(F.min_by("holder", "depth").alias("holder"), F.min("depth").alias("depth"))
    a = hit(through_bases(nearest.select(*cols)).join(members, ["holder", "name"]), 0, F.col("up"))
    # a name sees the containers around it, and a type among them sees its bases
    around = r.where(plain).join(scoped, "from_node").select(*cols)
    b = hit(through_bases(around).join(members, ["holder", "name"]), 1, F.col("depth") * (1 << 32) + F.col("up"))
    # receivers with a declared or constructed type: the type by its name, then its members
    held = r.where(~plain & ~selfish).withColumn("receiver", _bare(F.col("receiver"))).join(scoped, "from_node").join(look["hint"], ["holder", "receiver"])
    held = held.groupBy("ref", "kind", "name", "lang").agg(F.min_by("type_name", "depth").alias("type_name"))
    held = held.join(look["named"], "type_name").where(F.coalesce(F.col("lang") == F.col("type_lang"), F.lit(True))).select("ref", "kind", "name", "holder", F.lit(0).alias("depth"))
    c = hit(through_bases(held).join(members, ["holder", "name"]), 2, F.col("up"))
    d = hit(r.where("target is not null").select("ref", "kind", "target").join(look["dotted"], "target"), 3, F.lit(0))
    found = [a, b, c, d]
    if precise is not None:
        p = precise.join(nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")).distinct(), "dst", "left")
        where = ["file_path", "at"] if "at" in precise.columns else ["file_path", "start_line", "name"]
        p = p.groupBy(*where).agg(F.count("dst").alias("n"), F.slice(F.array_sort(F.collect_set("dst")), 1, KEPT).alias("ids"), F.min("dst_kind").alias("dst_kind"))
        # where the name of a reference stands: at the end of its text
        placed = r.withColumn("at", F.col("start_byte") + F.octet_length("ref_text") - F.octet_length("name"))
        found.append(hit(placed.join(p, where), 4, F.lit(0)))
    # a plain read of a name that no scope holds is a builtin or a local, never a field elsewhere
    bare = r.where("target is null and (kind not in ('read', 'write') or receiver is not null)").select("ref", "kind", "name", F.coalesce("lang", F.lit("")).alias("lang"))
    # each kind of symbol counts for itself here: a name is looked up among those a reference may mean
    e = bare.join(look["anywhere"], ["name", "lang"]).where(F.array_contains(F.try_element_at(_allowed(), F.col("kind")), F.col("dst_kind")))
    found.append(hit(e, 5, F.lit(0)))
    return _best(reduce(DataFrame.unionByName, found)).select("ref", "rung", "n", "ids", "dst_kind")


def evidence(df: DataFrame) -> DataFrame:
    """Evidence of resolved references: a fact on the exact rungs, heuristic on the others, with the rung as label."""
    return df.withColumns({"evidence_tier": F.when(F.col("status") == "exact", "fact").otherwise("heuristic"), "evidence_label": F.col("step")})


def edge_kind(kind: Column, dst_kind: Column) -> Column:
    """Edge kind of a reference; a call of a type makes one, and a base that is an interface is implemented."""
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in EDGE_OF.items() for x in kv]), kind)
    return F.when((kind == "call") & dst_kind.isin(*_TYPES), "INSTANTIATES").when((kind == "inherit") & dst_kind.isin("interface", "trait"), "IMPLEMENTS").otherwise(out)


def edges_of(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of resolved references and of containment, one row per identity (src, dst, kind, line, start_byte)."""
    byte = F.col("start_byte") if "start_byte" in resolved.columns else F.lit(None).cast("int")
    r = evidence(resolved).where("dst is not null and dst <> from_node")
    found = r.select(F.col("from_node").alias("src"), "dst", edge_kind(F.col("kind"), F.col("dst_kind")).alias("kind"), "file_path", F.col("status").alias("resolution"), "evidence_tier", "evidence_label", F.col("start_line").alias("line"), byte.alias("start_byte")).where("kind is not null")
    held = nodes.where("parent_id is not null").join(nodes.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    held = held.select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("kind"), "file_path", F.lit("exact").alias("resolution"), F.lit("fact").alias("evidence_tier"), F.lit("containment").alias("evidence_label"), F.col("start_line").alias("line"), F.lit(None).cast("int").alias("start_byte"))
    return found.union(held).groupBy("src", "dst", "kind", "line", "start_byte").agg(*[F.min(c).alias(c) for c in ("file_path", "resolution", "evidence_tier", "evidence_label")])


def param_binds(calls: DataFrame, args: DataFrame, params: DataFrame) -> DataFrame:
    """PARAM_BINDS edges: the n-th positional argument of a call and the callee's n-th parameter, an inner join on ordinals.

    ``calls(call, callee)``; ``args(call, position, src)``, where ``src`` is the value that the argument names or else the calling
    symbol; ``params(id, parent_id, name, position)``, positions from 0.  A first parameter called self, cls or this takes none.
    """
    first = params.where("position = 0").groupBy("parent_id").agg(F.max(F.col("name").isin("self", "cls", "this")).alias("bound"))
    p = params.join(first, "parent_id").where("not (bound and position = 0)").select(F.col("parent_id").alias("callee"), F.col("id").alias("dst"), (F.col("position") - F.col("bound").cast("int")).alias("position"))
    out = args.join(calls, "call").join(p, ["callee", "position"])
    return out.select("src", "dst", F.lit("PARAM_BINDS").alias("kind"), *[c for c in ("file_path", "line") if c in args.columns])


def returns(calls: DataFrame, writes: DataFrame) -> DataFrame:
    """RETURNS edges: from the callee to the value that the smallest assignment around the call writes.

    ``calls(call, callee, file_path, start_byte, end_byte)`` and perhaps ``line``, which the edges keep; ``writes(value, file_path, start_byte, end_byte)``.
    """
    keep = ["line"] if "line" in calls.columns else []
    w = writes.select("file_path", F.col("value").alias("dst"), F.col("start_byte").alias("a"), F.col("end_byte").alias("b"))
    j = stab(calls, w, ["file_path"], "start_byte", "a", "b").where("b >= end_byte")
    j = j.groupBy("call", F.col("callee").alias("src"), "file_path", *keep).agg(F.min(F.struct(F.expr("b - a").alias("len"), F.col("a"), F.col("dst"))).alias("w"))
    return j.select("src", F.col("w.dst").alias("dst"), F.lit("RETURNS").alias("kind"), "file_path", *keep)


def boundaries_of(resolved: DataFrame) -> DataFrame:
    """Where a walk stops for want of a decision: calls with several, but not too many, candidates."""
    b = resolved.where(F.col("n_candidates").between(2, NOTED) & (F.col("status") == "ambiguous"))
    return b.select(F.col("from_node").alias("node_id"), F.lit("dynamic_dispatch").alias("kind"), F.col("ref_text").alias("detail"), "candidates", F.col("start_line").alias("line"), "file_path")


def coverage(resolved: DataFrame) -> DataFrame:
    """Balanced counters per file (total = exact + inferred + unresolved), and whether data flow was read at all."""
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("int"))
    flow = F.when(F.max(F.col("kind").isin("read", "write")), "computed").otherwise("not_computed")
    return resolved.groupBy("file_path").agg(F.count("*").alias("refs_total"), n("exact").alias("refs_exact"), n("inferred").alias("refs_inferred"), n("ambiguous", "external").alias("refs_unresolved"), flow.alias("dataflow_status"))
