"""Contracts from references: adapters (data rows) name the calls and decorators that expose or consume a key.

An adapter matches a reference by its dotted name or by a suffix of it.  Keys come from a positional or named argument, are
normalised by the kind of contract, and become ``contract`` nodes whose id depends on kind and key alone, so that two services
that spell one route differently meet in one node.  A key that is no literal gives a boundary, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

ADAPTERS = "nth int, adapter string, lang string, ref_kind string, name string, contract_kind string, role string, method string, arg int, arg_name string"
#: Adapters written for this engine: name, language, reference kind, dotted name, kind of contract, role, verb, argument, its name.
SHIPPED = (
    *(("flask-route", "python", "decorate", f"app.{v}", "http_route", "exposes", v, 0, "rule") for v in ("get", "post", "put", "delete", "patch")),
    ("flask-route", "python", "decorate", "app.route", "http_route", "exposes", None, 0, "rule"),
    *(("fastapi-router", "python", "decorate", f"router.{v}", "http_route", "exposes", v, 0, "path") for v in ("get", "post", "put", "delete", "patch")),
    *(("requests", "python", "call", f"requests.{v}", "http_route", "consumes", v, 0, "url") for v in ("get", "post", "put", "delete", "patch")),
    *(("httpx", "python", "call", f"httpx.{v}", "http_route", "consumes", v, 0, "url") for v in ("get", "post", "put", "delete", "patch")),
    ("celery-task", "python", "call", "app.send_task", "topic", "consumes", None, 0, "name"),
    ("kafka-producer", "python", "call", "producer.send", "topic", "exposes", None, 0, "topic"),
    ("kafka-consumer", "python", "call", "consumer.subscribe", "topic", "consumes", None, 0, "topics"),
    ("click-command", "python", "decorate", "click.command", "cli_command", "exposes", None, 0, "name"),
    ("environment", "python", "call", "os.getenv", "config_key", "consumes", None, 0, "key"),
    ("environment", "python", "call", "os.environ.get", "config_key", "consumes", None, 0, "key"),
    ("spring-mapping", "java", "decorate", "GetMapping", "http_route", "exposes", "get", 0, "value"),
    ("spring-mapping", "java", "decorate", "PostMapping", "http_route", "exposes", "post", 0, "value"),
    ("fetch", "typescript", "call", "fetch", "http_route", "consumes", None, 0, None),
    ("fetch", "javascript", "call", "fetch", "http_route", "consumes", None, 0, None),
)
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
_QUOTED = r"^\s*[rbfu]{0,2}(['\"`])(.*)\1\s*$"


def adapters(spark, rows=SHIPPED) -> DataFrame:
    """Rows as a table of ``ADAPTERS``, numbered in load order; names must be texts (a YAML ``on`` or ``no`` is refused)."""
    for r in rows:
        if not all(isinstance(x, str) for x in r[:6]):
            raise TypeError(f"adapter {r[0]!r}: names must be texts")
        if r[5] not in ("exposes", "consumes"):
            raise ValueError(f"adapter {r[0]!r}: role {r[5]!r}")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ADAPTERS)


def matches(ref_text: Column, name: Column) -> Column:
    """The dotted name itself, or one that ends with it after a dot."""
    return (ref_text == name) | ref_text.endswith(F.concat(F.lit("."), name))


def verb(method: Column, ref_name: Column, options: Column) -> Column:
    """The adapter's own verb; else one in an option ``method: "X"`` or ``methods=["X"]``, else one that the name holds; else ANY."""
    said = F.upper(F.regexp_extract(F.coalesce(options, F.lit("")), r"(?i)\bmethods?['\"]?\s*[:=]\s*\[?\s*['\"](\w+)", 1))
    inside = F.lit(None).cast("string")
    for v in reversed(VERBS):
        inside = F.when(F.lower(ref_name).contains(v), v.upper()).otherwise(inside)
    return F.coalesce(F.upper(method), F.when(said != "", said), inside, F.lit("ANY"))


def literal(arg: Column) -> Column:
    """The text of a quoted literal; null for anything else."""
    return F.when(arg.rlike(_QUOTED) & ~arg.rlike(r"^\s*f['\"].*\{"), F.regexp_extract(arg, _QUOTED, 2))


def leading_literal(arg: Column) -> Column:
    """The quoted text at the start of an expression, the known part of a dynamic key."""
    return F.regexp_extract(arg, r"^\s*[rbfu]{0,2}(['\"`])(.*?)\1", 2)


def normalise(kind: Column, key: Column, method: Column) -> Column:
    """The normal form of a key by its kind; other kinds only lose quotes and blanks."""
    return F.when(kind == "http_route", X.normalise_http(method, key)).when(kind.isin("rpc_service", "spi"), X.normalise_fqn(key)).when(kind == "db_table", X.normalise_table(key)).when(kind == "topic", X.normalise_topic(key)).otherwise(X.unquote(key))


def contract_id(kind: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", F.lit("contract"), kind, key), 256), 1, 32)


def detect(refs: DataFrame, adapter: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(contracts, edges, boundaries)`` of references ``(from_node, kind, ref_text, lang, file_path, start_line, args array<struct<index, name, text>>)``.

    Each reference takes the first adapter, in load order, that matches it and names a key.
    """
    a = F.broadcast(adapter.withColumnsRenamed({"lang": "a_lang", "ref_kind": "a_kind"}))  # a data file
    j = refs.join(a, (F.col("kind") == F.col("a_kind")) & (F.col("lang") == F.col("a_lang")) & matches(F.col("ref_text"), F.col("name")) if "name" not in refs.columns else (F.col("kind") == F.col("a_kind")) & (F.col("lang") == F.col("a_lang")) & matches(F.col("ref_text"), a["name"]))
    by_name = F.get(F.filter("args", lambda x: x["name"] == F.col("arg_name")), F.lit(0))["text"]
    by_place = F.get(F.filter("args", lambda x: x["name"].isNull() & (x["index"] == F.col("arg"))), F.lit(0))["text"]
    options = F.array_join(F.transform("args", lambda x: F.concat_ws("=", x["name"], x["text"])), " ")
    j = j.withColumns({"raw": F.coalesce(by_place, by_name), "options": options}).where("raw is not null")
    ref = ["from_node", "kind", "ref_text", "file_path", "start_line", "raw"]
    j = j.withColumn("first", F.row_number().over(W.partitionBy(*ref).orderBy("nth"))).where("first = 1")
    key = literal(F.col("raw"))
    j = j.withColumns({"literal": key, "key": normalise(F.col("contract_kind"), key, verb(F.col("method"), F.substring_index("ref_text", ".", -1), F.col("options")))})
    known = j.where("literal is not null and literal <> ''").withColumn("id", contract_id(F.col("contract_kind"), F.col("key")))
    contracts = known.groupBy("id").agg(F.min("contract_kind").alias("contract_kind"), F.min("key").alias("name"))
    contracts = contracts.select("id", F.lit("contract").alias("kind"), "name", F.concat_ws("#", F.lit("contract"), "contract_kind", "name").alias("qualified_name"), "contract_kind", F.lit("*").alias("lang"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    edges = known.select(F.col("from_node").alias("src"), F.col("id").alias("dst"), F.upper("role").alias("kind"), "file_path", F.col("start_line").alias("line"), F.col("adapter").alias("evidence_label")).distinct()
    edges = edges.select("src", "dst", "kind", "file_path", "line", F.lit("inferred").alias("resolution"), F.lit("heuristic").alias("evidence_tier"), "evidence_label")
    loose = j.where("literal is null").select(F.col("from_node").alias("node_id"), F.lit("dynamic_contract_key").alias("kind"), F.concat_ws(" ", "contract_kind", leading_literal(F.col("raw"))).alias("detail"), "file_path", F.col("start_line").alias("line"))
    return contracts, edges, loose.distinct()


def unclaimed(refs: DataFrame, adapter: DataFrame, most: int = 10) -> DataFrame:
    """Decorators with a route-, topic- or environment-shaped literal that no adapter claims: ``(lang, name, n, example)``, the most frequent first."""
    a = F.broadcast(adapter.select(F.col("lang").alias("a_lang"), F.col("ref_kind").alias("a_kind"), F.col("name").alias("a_name")).distinct())
    shaped = F.exists("args", lambda x: x["text"].rlike(r"^\s*['\"](/[\w{}<>:/.*-]*|[a-z][\w-]*(\.[\w-]+)+|[A-Z][A-Z0-9]*(_[A-Z0-9]+)+)['\"]\s*$"))
    d = refs.where((F.col("kind") == "decorate") & shaped)
    d = d.join(a, (F.col("lang") == F.col("a_lang")) & (F.col("kind") == F.col("a_kind")) & matches(F.col("ref_text"), F.col("a_name")), "left_anti")
    example = F.min(F.struct("file_path", "start_line"))
    return d.groupBy("lang", F.col("ref_text").alias("name")).agg(F.count("*").alias("n"), example.alias("example")).orderBy(F.desc("n"), "name").limit(most)


def entry_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the ENTRY_POINT flag on every source of an EXPOSES edge."""
    e = edges.where("kind = 'EXPOSES'").select(F.col("src").alias("id")).distinct().withColumn("is_entry", F.lit(True))
    return nodes.join(e, "id", "left").withColumn("flags", F.when(F.col("is_entry"), F.coalesce("flags", F.lit(0)).bitwiseOR(F.lit(256))).otherwise(F.col("flags"))).drop("is_entry")
