"""The graph schema as data: node types, allowed edges and edge types with their reverses.

These rows serve the bindings; a user's own schema is read from TOML by :func:`load_schema`."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

#: node type, directory, required fields, allowed statuses (none: any)
NODE_TYPES = [
    ("feature", "features", ["status", "owner"], ["draft", "active", "completed", "superseded"]),
    ("persona", "personas", ["status"], []),
    ("component", "components", ["status", "owner"], ["active", "retired"]),
    ("decision", "decisions", ["status", "owner"], ["discussing", "decided"]),
    ("epic", "epics", ["status", "owner"], []),
]
#: source type, edge type, target type (* is any type)
ALLOWED_EDGES = [
    ("feature", "serves", "persona"),
    ("feature", "uses", "component"),
    ("persona", "child_of", "epic"),
    ("epic", "child_of", "epic"),
    ("*", "depends_on", "feature"),
]
#: edge type, reverse
EDGE_TYPES = [
    ("serves", "served_by"),
    ("served_by", "serves"),
    ("uses", "used_by"),
    ("used_by", "uses"),
    ("depends_on", "dependency_of"),
    ("dependency_of", "depends_on"),
    ("child_of", "parent_of"),
    ("parent_of", "child_of"),
]

NODE_DDL = "id string, node_type string, status string, owner string, created timestamp, updated timestamp, tags array<string>, edges array<struct<target:string,type:string,valid_from:date,valid_until:date,annotation:string>>, title string, body string, file_path string, content_hash string"
ENTRY_DDL = "v int, id string, ts timestamp, agent string, kind string, summary string, detail string, tags array<string>, files array<string>, `references` array<string>, session_id string, worktree_hash string, branch string, head string, provisional boolean, confidence string, severity string, alternatives array<string>, chosen string, rationale string, final boolean, _corrupt string"


def load_schema(spark: SparkSession, toml_text: str) -> dict[str, DataFrame]:
    """node_types, allowed_edges and edge_types of a schema file.

    Tables: ``[node_types.<name>]`` with directory, required_fields and allowed_statuses,
    ``[[edges]]`` with source, type and target, ``[edge_types.<name>]`` with reverse."""
    data = tomllib.loads(toml_text)
    types = [(k, v.get("directory"), v.get("required_fields", []), v.get("allowed_statuses", [])) for k, v in data.get("node_types", {}).items()]
    allowed = [(e["source"], e["type"], e["target"]) for e in data.get("edges", [])]
    kinds = [(k, v.get("reverse")) for k, v in data.get("edge_types", {}).items()]
    return {
        "node_types": spark.createDataFrame(types, "node_type string, directory string, required array<string>, statuses array<string>"),
        "allowed_edges": spark.createDataFrame(allowed, "source_type string, edge_type string, target_type string"),
        "edge_types": spark.createDataFrame(kinds, "edge_type string, reverse string"),
    }
