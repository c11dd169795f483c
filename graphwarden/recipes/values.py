"""Recipes on single vertices and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphwarden.functions.keys import blank, prop, set_prop
from graphwarden.model import Graph
from graphwarden.operators.migrate import Outcome, fill_values, rename_property, reset_edge_props, with_types
from graphwarden.operators.repair import delete_vertices
from graphwarden.operators.structure import is_cousin, tree
from graphwarden.recipes.common import Labels

# Node types and properties the recipes fill.
FALSE = "false"
BOOLEAN_DEFAULTS = {
    "generic-vnf": {"is-closed-loop-disabled": FALSE},
    "vnfc": {"is-closed-loop-disabled": FALSE},
    "vserver": {"is-closed-loop-disabled": FALSE},
    "l3-network": {"is-bound-to-vpn": FALSE, "is-provider-network": FALSE, "is-shared-network": FALSE,
                   "is-external-network": FALSE},
    "subnet": {"dhcp-enabled": FALSE},
    "l-interface": {"is-port-mirrored": FALSE, "is-ip-unnumbered": FALSE},
    "vf-module": {"is-base-vf-module": FALSE},
    "vlan": {"is-ip-unnumbered": FALSE},
}
REGION_BOOLEAN_DEFAULTS = {"cloud-region": {"orchestration-disabled": FALSE}}
MULTICAST_DEFAULTS = {"l-interface": {"l2-multicasting": FALSE}}
IN_MAINT_TYPES = ["generic-vnf", "l-interface", "lag-interface", "logical-link", "p-interface", "vlan", "vnfc",
                  "vserver", "pserver", "pnf", "nos-server"]
REGION_IN_MAINT_TYPES = ["zone", "cloud-region"]
MANAGED_VNF_TYPES = ["HN", "HP", "HG"]
RENAMES = [
    # node type, old property, new property
    ("instance-group", "model-invariant-id", "model-invariant-id-local"),
    ("instance-group", "model-version-id", "model-version-id-local"),
    ("instance-group", "sub-type", "instance-group-role"),
    ("instance-group", "type", "instance-group-type"),
    ("vnfc", "model-invariant-id", "model-invariant-id-local"),
    ("vnfc", "model-version-id", "model-version-id-local"),
]
EQUIP_TYPES = {"pserver": (["Server", "server"], "SERVER"), "pnf": (["Switch", "switch"], "SWITCH")}


def boolean_defaults(g: Graph) -> Outcome:
    """Booleans that are absent become false."""
    spec = {**BOOLEAN_DEFAULTS, **REGION_BOOLEAN_DEFAULTS}
    spec = {**spec, "l-interface": {**spec["l-interface"], **MULTICAST_DEFAULTS["l-interface"]}}
    v, changed = fill_values(g.v, spec)
    return Outcome(v, g.e, changed)


def in_maint_defaults(g: Graph) -> Outcome:
    """In-maint becomes false where absent."""
    v, changed = fill_values(g.v, {t: {"in-maint": FALSE} for t in IN_MAINT_TYPES + REGION_IN_MAINT_TYPES})
    return Outcome(v, g.e, changed)


def management_option(g: Graph, option: str) -> Outcome:
    """The management option of VNFs of the managed types."""
    v, changed = fill_values(g.v, {"generic-vnf": {"management-option": option}}, {"vnf-type": MANAGED_VNF_TYPES})
    return Outcome(v, g.e, changed)


def local_renames(g: Graph) -> Outcome:
    """Six property renames."""
    v, changed = g.v, None
    for node_type, old, new in RENAMES:
        v, ids = rename_property(v, old, new, [node_type])
        changed = ids if changed is None else changed.unionByName(ids)
    return Outcome(v, g.e, changed)


def normalise_equip_type(g: Graph) -> Outcome:
    """One spelling of the equipment type."""
    hit, value = F.lit(False), F.lit(None).cast("string")
    for node_type, (spellings, norm) in EQUIP_TYPES.items():
        mine = (F.col("node_type") == node_type) & prop("equip-type").isin(*spellings)
        hit, value = hit | F.coalesce(mine, F.lit(False)), F.when(mine, norm).otherwise(value)
    v = g.v.withColumn("props", F.when(hit, set_prop(F.col("props"), "equip-type", value)).otherwise(F.col("props")))
    return Outcome(v, g.e, g.v.where(hit).select("vid"))


def fqdn_from_hostname(g: Graph) -> Outcome:
    """Servers without fqdn take a host name that has a dot; the others are fallout."""
    empty = F.coalesce((F.col("node_type") == "pserver") & blank(prop("fqdn")), F.lit(False))
    dotted = F.coalesce(F.contains(prop("hostname"), F.lit(".")), F.lit(False))
    v = g.v.withColumn("props", F.when(empty & dotted, set_prop(F.col("props"), "fqdn", prop("hostname"))).otherwise(
        F.col("props")))
    bad = g.v.where(empty & ~dotted).select(prop("hostname").alias("line"), F.lit("host name without a dot").alias("reason"))
    return Outcome(v, g.e, g.v.where(empty & dotted).select("vid"), bad)


def canonical_link_name(name: Column) -> Column:
    """Two ``host:port`` parts in host order around a bar; other names stay."""
    parts = F.split(name, r"\|")
    two = F.slice(parts, 1, 2)
    ordered = F.array_sort(F.transform(two, lambda p: F.struct(F.split(p, ":")[0].alias("h"), F.get(F.split(p, ":"), F.lit(1)).alias("p"))))
    return F.when(F.size(parts) > 1, F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", x["h"], x["p"])), "|")).otherwise(name)


def module_edge_props(g: Graph) -> Outcome:
    """Edges between vf-modules and vnfcs take the properties of their rule."""
    e, unknown = reset_edge_props(g.e, g.v, [("vf-module", "vnfc")], g.rules)
    return Outcome(g.v, e, None, unknown.select(F.col("eid").alias("line"), F.lit("no rule").alias("reason")))


def delete_follows_containment(
    g: Graph, except_pair: tuple[str, str] = ("model-element", "constrained-element-set")
) -> Outcome:
    """Delete-other-v equals containment on containment edges, but for one (source, target) pair."""
    spared = with_types(g.e.where(~is_cousin()).select("eid", "src", "dst"), g.v, list(except_pair)).where(
        (F.col("src_type") == except_pair[0]) & (F.col("dst_type") == except_pair[1])).select(
        "eid", F.lit(True).alias("_spared"))
    out = g.e.join(spared, "eid", "left")
    due = ~is_cousin() & F.col("delete_other_v").isNotNull() & F.col("_spared").isNull()
    e = out.select(*[F.when(due, F.col("contains_other_v")).otherwise(F.col(c)).alias(c)
                     if c == "delete_other_v" else F.col(c) for c in g.e.columns])
    return Outcome(g.v, e)


def unused_interfaces(g: Graph, source: str, labels: Labels = Labels()) -> Outcome:
    """Interfaces of a source that sit in a pnf and have neither cousins nor children go."""
    mine = g.v.where((F.col("node_type") == "p-interface") & (F.col("source_of_truth") == source)).select("vid")
    t = tree(g.e)
    boxes = g.v.where(F.col("node_type") == "pnf").select(F.col("vid").alias("parent_vid"))
    in_pnf = t.join(boxes, "parent_vid", "left_semi").select(F.col("child_vid").alias("vid"))
    loose = g.e.where(is_cousin()).select(F.explode(F.array("src", "dst")).alias("vid"))
    gone = mine.join(in_pnf, "vid", "left_semi").join(loose, "vid", "left_anti").join(
        t.select(F.col("parent_vid").alias("vid")), "vid", "left_anti")
    v, e = delete_vertices(g.v, g.e, gone)
    return Outcome(v, e, gone)
