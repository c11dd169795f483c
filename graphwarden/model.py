"""Table shapes of the property graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

VERTEX_DDL = (
    "vid BIGINT, node_type STRING, uri STRING, uuid STRING, resource_version STRING, "
    "created_ts BIGINT, last_mod_ts BIGINT, end_ts BIGINT, source_of_truth STRING, "
    "props MAP<STRING,STRING>"
)
EDGE_DDL = (
    "eid STRING, src BIGINT, dst BIGINT, label STRING, contains_other_v STRING, "
    "delete_other_v STRING, prevent_delete STRING, end_ts BIGINT, props MAP<STRING,STRING>"
)
NODE_TYPE_DDL = (
    "node_type STRING, keys ARRAY<STRING>, dependent_on ARRAY<STRING>, top_level BOOLEAN, "
    "indexed ARRAY<STRING>, unique_props ARRAY<STRING>, name_props ARRAY<STRING>, "
    "list_props ARRAY<STRING>, prop_types MAP<STRING,STRING>, uri_template STRING"
)
EDGE_RULE_DDL = (
    "from_type STRING, to_type STRING, label STRING, direction STRING, multiplicity STRING, "
    "contains_other_v STRING, delete_other_v STRING, prevent_delete STRING, is_default BOOLEAN, "
    "private BOOLEAN"
)

VERTEX_COLS = [c.split()[0] for c in VERTEX_DDL.split(", ")]
EDGE_COLS = [c.split()[0] for c in EDGE_DDL.split(", ")]


@dataclass(frozen=True)
class Graph:
    v: DataFrame
    e: DataFrame
    nt: DataFrame
    rules: DataFrame


def resolve_direction(rule: dict) -> dict:
    """Replace the ``${direction}`` / ``!${direction}`` placeholders of an edge rule."""
    d = rule["direction"]
    swap = {"OUT": "IN", "IN": "OUT", "BOTH": "BOTH"}
    return {
        k: d if x == "${direction}" else swap[d] if x == "!${direction}" else x
        for k, x in rule.items()
    }
