"""Grooming: repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.bounds import few, within
from graphwarden.functions.keys import set_prop
from graphwarden.operators import groom
from graphwarden.operators.filters import filter_props
from graphwarden.operators.structure import count_descendants, count_edges, edge_detail

# Limits of the repair tools.
MAX_FIXES = 150
MAX_EDGES = 10
MAX_DESCENDANTS = 10
PROTECTED_TYPES = ("cloud-region",)
DUMMY_BOOLEAN, DUMMY_INTEGER = "false", "9999"


def select_candidates(
    c: DataFrame, edges_only: bool = False, skip_orphans: bool = False, fix_dupes: bool = True
) -> DataFrame:
    """Candidates a run may touch."""
    if edges_only:
        return c.where(F.col("kind") == groom.BAD_EDGE)
    if skip_orphans:
        c = c.where(F.col("kind") != groom.ORPHAN)
    if not fix_dupes:
        c = c.where(F.col("kind") != groom.DUPLICATE)
    return c


def apply_cap(c: DataFrame, max_fixes: int = MAX_FIXES) -> DataFrame:
    """R2: above the cap nothing at all is fixed."""
    return c if within(c, max_fixes) else c.limit(0)


def confirm(first: DataFrame, second: DataFrame) -> DataFrame:
    """Run-1 candidates that run 2 still finds."""
    return first.join(second.select("kind", "id").distinct(), ["kind", "id"], "left_semi")


def delete_vertices(v: DataFrame, e: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop vertices and their incident edges."""
    gone = few(ids.select("vid").distinct(), "gone")
    return (
        v.join(gone, "vid", "left_anti"),
        e.join(gone.select(F.col("vid").alias("src")), "src", "left_anti")
        .join(gone.select(F.col("vid").alias("dst")), "dst", "left_anti")
        .select(*e.columns),
    )


def delete_edges(e: DataFrame, eids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining edges, one row per requested id with what was deleted)."""
    wanted = few(eids.select("eid").distinct(), "wanted")
    # a left join cannot broadcast its left side, so without this all edges would be shuffled for a few ids
    found = e.select("eid", "src", "dst", "label").join(wanted, "eid", "left_semi")
    report = wanted.join(found, "eid", "left").withColumn(
        "status", F.when(F.col("src").isNull(), "not_found").otherwise("deleted"))
    return e.join(wanted, "eid", "left_anti"), report


def fix_bad_edges(v: DataFrame, e: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete the broken end vertex where it exists, and the edge where it does not."""
    ends = few(bad.select(F.col("bad_vid").alias("vid")).distinct(), "ends")
    broken = v.join(ends, "vid", "left_semi")
    absent = few(bad.where(F.col("reason") == "absent").select("eid").distinct(), "absent")
    v2, e2 = delete_vertices(v, e, broken.select("vid"))
    return v2, e2.join(absent, "eid", "left_anti")


def fill_dummy_props(v: DataFrame, nt: DataFrame, node_type: str) -> DataFrame:
    """Give untyped vertices a type and recognisable dummy values in the indexed properties."""
    row = nt.where(F.col("node_type") == node_type).select("indexed", "prop_types").first()
    if row is None:
        raise ValueError(f"unknown node type {node_type}")
    vid = F.col("vid").cast("string")
    dummy = F.concat(vid, F.lit("dummy"))
    props = F.col("props")
    for name in row["indexed"]:
        kind = (row["prop_types"] or {}).get(name, "String").lower()
        value = {"long": vid, "boolean": F.lit(DUMMY_BOOLEAN), "integer": F.lit(DUMMY_INTEGER)}.get(kind, dummy)
        props = set_prop(props, name, value)
    untyped = F.col("node_type").isNull() | (F.col("node_type") == "")
    fill = {"node_type": F.lit(node_type), "uri": dummy, "uuid": dummy, "source_of_truth": dummy,
            "props": set_prop(props, "unique-key", dummy)}
    return v.select(*[
        F.when(untyped, fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in v.columns])


def guard_delete(
    v: DataFrame, e: DataFrame, ids: DataFrame, protected: tuple[str, ...] = PROTECTED_TYPES,
    max_edges: int = MAX_EDGES, max_descendants: int = MAX_DESCENDANTS, override: bool = False,
) -> DataFrame:
    """(vid, node_type, n_edges, n_descendants, allowed, reasons) per requested vertex; one that does not exist is
    never allowed and has the reason ``not_found``."""
    ask = ids.select("vid").distinct().join(
        v.select("vid", "node_type", F.lit(True).alias("_found")), "vid", "left")
    c = F.col
    rows = ask.join(count_edges(e, ask), "vid").join(count_descendants(e, ask), "vid")
    reasons = F.concat_ws(
        "|",
        F.when(c("_found").isNull(), "not_found"),
        F.when(c("n_descendants") > max_descendants, "descendants"),
        F.when(c("n_edges") > max_edges, "edges"),
        F.when(c("node_type").isin(*protected), "protected_type"))
    return rows.withColumn("reasons", reasons).withColumn(
        "allowed", c("_found").isNotNull() if override else c("reasons") == "").drop("_found")


def collect_data(
    v: DataFrame, e: DataFrame, ids: DataFrame | None = None, spec: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes with edge and descendant counts, their edge ends), by id list or property filter."""
    nodes = v if ids is None else v.join(ids.select("vid").distinct(), "vid", "left_semi")
    if spec:
        nodes = filter_props(nodes, spec)
    counted = nodes.join(count_edges(e, nodes), "vid").join(count_descendants(e, nodes), "vid")
    return counted, edge_detail(v, e, nodes)
