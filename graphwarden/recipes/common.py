"""Shared pieces of the recipes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from graphwarden.functions.bounds import SMALL_ROWS, few, within
from graphwarden.functions.keys import empty_props, set_prop
from graphwarden.functions.numbering import number_rows
from graphwarden.functions.storage import cut, written
from graphwarden.model import EDGE_COLS, VERTEX_COLS


@dataclass(frozen=True)
class Labels:
    """Edge labels of the store; replace them where yours carry a name space."""

    belongs_to: str = "BelongsTo"
    uses: str = "Uses"
    composed_of: str = "ComposedOf"
    binds_to: str = "BindsTo"
    forwards_to: str = "ForwardsTo"
    hosted_on: str = "HostedOn"
    links_to: str = "LinksTo"
    is_a: str = "IsA"
    applies_to: str = "AppliesTo"
    located_in: str = "LocatedIn"


@dataclass(frozen=True)
class Step:
    """One hop of a path: along an edge label, to a node type, under property conditions."""

    direction: str
    label: str
    node_type: str
    where: tuple = ()


def pick(v: DataFrame, node_type: str, **props: str) -> DataFrame:
    """(vid, named properties) of one node type; ``name=property`` pairs."""
    return v.where(F.col("node_type") == node_type).select(
        "vid", *[F.col("props").getItem(p).alias(n) for n, p in props.items()])


def walk(v: DataFrame, e: DataFrame, start: DataFrame, steps: list[Step]) -> DataFrame:
    """Follow ``steps`` from ``start.vid``; the other columns of ``start`` are carried along.

    While few rows are under way they are written and broadcast, so a short feed
    scans the edges of its labels without shuffling them; from the first hop with
    many rows on, the rest of the path is one plan of shuffle joins.
    """
    carried = [c for c in start.columns if c != "vid"]
    start = written(start, "walk")
    is_small = within(start, SMALL_ROWS)
    hint = lambda df: F.broadcast(df) if is_small else df
    for s in steps:
        near, far = ("src", "dst") if s.direction == "out" else ("dst", "src")
        hop = e.where(F.col("label") == s.label).select(F.col(near).alias("vid"), F.col(far).alias("_to"))
        ends = v.where(F.col("node_type") == s.node_type)
        for c in s.where:
            ends = ends.where(c)
        reached = hint(start).join(hop, "vid").select(*carried, F.col("_to").alias("vid"))
        if is_small:
            reached = cut(reached, "walk")
            is_small = within(reached, SMALL_ROWS)
        # ids are unique, so this join adds no rows and the next hop may keep the hint
        start = hint(reached).join(ends.select("vid"), "vid").select(*carried, "vid")
    return start


def update_props(v: DataFrame, values: DataFrame, names: dict[str, str]) -> DataFrame:
    """Set ``names`` (property -> column of ``values``, one row per vid) where the column is not null."""
    new = few(values.select("vid", *[
        F.col(c).cast("string").alias(f"_new_{i}") for i, c in enumerate(names.values())]), "values")
    out = v.join(new, "vid", "left")
    props = F.col("props")
    for i, name in enumerate(names):
        value = F.col(f"_new_{i}")
        props = F.when(value.isNotNull(), set_prop(props, name, value)).otherwise(props)
    return out.select(*[props.alias("props") if c == "props" else F.col(c) for c in v.columns])


def next_vid(v: DataFrame) -> int:
    """First id above all ids in use."""
    return (v.agg(F.max("vid")).first()[0] or 0) + 1


def make_vertices(
    rows: DataFrame, order_by: list[str], first_vid: int, node_type: str, props: dict[str, Column], uri: Column,
    source: str = "migrations",
) -> DataFrame:
    """Number ``rows`` from ``first_vid`` and give them the vertex columns next to their own."""
    n = number_rows(rows, order_by, "_rn").withColumn("vid", F.col("_rn") + (first_vid - 1)).drop("_rn")
    bag = F.map_filter(F.create_map(*[x for k, c in props.items() for x in (F.lit(k), c.cast("string"))]),
                       lambda _, x: x.isNotNull()) if props else empty_props()
    null = F.lit(None)
    cols = {"node_type": F.lit(node_type), "uri": uri, "uuid": F.md5(uri.cast("binary")),
            "resource_version": F.lit("1"), "created_ts": null.cast("long"), "last_mod_ts": null.cast("long"),
            "end_ts": null.cast("long"), "source_of_truth": F.lit(source), "props": bag}
    keep = [c for c in n.columns if c not in VERTEX_COLS]
    return n.select(*keep, *[cols[c].alias(c) if c in cols else F.col(c) for c in VERTEX_COLS])


def make_edges(
    rows: DataFrame, src: str, dst: str, label: str, contains: str = "NONE", rules: DataFrame | None = None,
    types: tuple[str | Column, str | Column] | None = None,
) -> DataFrame:
    """Edges of one label between two id columns.

    With ``rules`` and the node types of both columns, the rule of the types and the label gives direction, containment,
    delete and prevent values; ``contains`` tells whether it is a containing one, and stands where there is no rule.
    """
    swap, values = F.lit(False), {"contains_other_v": F.lit(contains), "delete_other_v": F.lit("NONE"), "prevent_delete": F.lit("NONE")}
    if rules is not None:
        a, b = [F.lit(t) if isinstance(t, str) else t for t in types]
        cousin = F.coalesce(F.col("contains_other_v"), F.lit("NONE")) == "NONE"
        for r in rules.where((F.col("label") == label) & (cousin if contains == "NONE" else ~cousin)).distinct().collect():  # of one label
            forth = (a == r["from_type"]) & (b == r["to_type"])
            back = (a == r["to_type"]) & (b == r["from_type"]) & ~forth
            swap = F.when(forth, r["direction"] == "IN").when(back, r["direction"] != "IN").otherwise(swap)
            values = {c: F.when(forth | back, r[c]).otherwise(x) for c, x in values.items()}
    ends = rows.select(F.when(swap, F.col(dst)).otherwise(F.col(src)).alias("src"), F.when(swap, F.col(src)).otherwise(F.col(dst)).alias("dst"),
                       *[x.alias(c) for c, x in values.items()])
    cols = {"eid": F.concat_ws(":", F.lit(label), "src", "dst"), "label": F.lit(label),
            "end_ts": F.lit(None).cast("long"), "props": empty_props()}
    return ends.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in EDGE_COLS])


def fallout(rows: DataFrame, line: str, reason: str) -> DataFrame:
    return rows.select(F.col(line).cast("string").alias("line"), F.lit(reason).alias("reason"))


def first_token(col: Column) -> Column:
    """Host part before the first dot; null if empty."""
    return F.nullif(F.split(col, r"\.")[0], F.lit(""))
