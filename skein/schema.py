"""Vocabularies and table schemas of the lineage graph; kinds are data, so a new kind needs no migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA_VERSION = 5

NODE_KINDS = ("service", "package", "module", "file", "class", "interface", "enum", "enum_member", "struct", "trait", "type_alias", "annotation", "function", "method", "constructor", "property", "field", "parameter", "variable", "constant", "contract")
EDGE_KINDS = ("CONTAINS", "IMPORTS", "EXPORTS", "INHERITS", "IMPLEMENTS", "OVERRIDES", "DECORATES", "HAS_TYPE", "INSTANTIATES", "THROWS", "CALLS", "REFERENCES", "READS", "WRITES", "PARAM_BINDS", "RETURNS", "FLOWS_TO", "EXPOSES", "CONSUMES", "USES_FIXTURE", "TESTS")
CALL_CHAIN = ("CALLS", "REFERENCES", "OVERRIDES", "IMPLEMENTS")
DATA_FLOW = ("READS", "WRITES", "PARAM_BINDS", "RETURNS")
CONTRACT = ("EXPOSES", "CONSUMES")
DEPENDENT = ("CALLS", "REFERENCES", "INHERITS", "IMPLEMENTS", "OVERRIDES", "INSTANTIATES", "HAS_TYPE", "IMPORTS", "DECORATES")
FLAGS = {"ASYNC": 1, "STATIC": 2, "ABSTRACT": 4, "FINAL": 8, "EXPORTED": 16, "GENERATED": 32, "TEST": 64, "DEPRECATED": 128, "ENTRY_POINT": 256, "OVERRIDE": 512}
CALLABLE, TYPES, VALUES = ("function", "method", "constructor"), ("class", "interface", "enum", "struct", "trait", "type_alias", "annotation"), ("property", "field", "parameter", "variable", "constant", "enum_member")


SPAN = "start_byte int, end_byte int, start_line int, start_col int, end_line int, end_col int"
NODES = (
    "id string, kind string, name string, qualified_name string, lang string, file_path string, service_id string, signature string, signature_hash string, docstring string, return_type string, type_ref string, visibility string, flags int, type_params array<string>, decorators array<string>, parent_id string, " + SPAN
)
EDGES = ("src string, dst string, kind string, file_path string, evidence_tier string, evidence_label string, confidence double, resolution string, provenance string, metadata string, start_byte int, end_byte int, line int, col int, end_line int, end_col int")
REFS = ("from_node string, ref_text string, ref_kind string, receiver_hint string, file_path string, " + SPAN + ", args array<struct<index int, text string, start_byte int, end_byte int, line int>>, value string")
TABLES = {
    "nodes": NODES,
    "edges": EDGES,
    "refs": REFS,
    "services": ("id string, name string, root string, kind string, manifest_path string"),
    "files": ("path string, lang string, service_id string, content_hash string, size_bytes long, parse_status string, skip_reason string"),
    "boundaries": ("node_id string, kind string, detail string, candidates array<string>, line int, col int"),
    "coverage": ("file_path string, nodes_found int, refs_total int, refs_exact int, refs_inferred int, refs_unresolved int, boundaries_count int, dataflow_status string"),
    "usage_sites": ("symbol_name string, usage_type string, file_path string, start_line int, context_before string, context_line string, context_after string, calling_symbol_id string"),
    "graph_meta": ("schema_version int, project_root string, commit_sha string, branch string, dirty boolean, build_digest string, deterministic_ok boolean, built_at timestamp"),
}


def struct(name: str) -> T.StructType:
    """The StructType of a table (needs a running session)."""
    return T.StructType.fromDDL(TABLES[name])


class SchemaMismatch(ValueError):
    """A stored graph of another version or with other columns."""


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns of table ``name``; missing ones are null, further ones go."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(name)])
