"""Registered queries for the recipes, with their SQL.  Feeds are derived from the tables as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.keys import prop
from graphwarden.functions.storage import new_path
from graphwarden.plans.oracle import graph_sql
from graphwarden.plans.registry import Registry
from graphwarden.recipes import feeds, models, servers, values
from graphwarden.sources.inventory import CODE, inventory, order_ports, port_name, text
from graphwarden.sources.tables import BASE, graph

query = Registry()


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def props(v: DataFrame, types: list[str], **names: str) -> DataFrame:
    return v.where(F.col("node_type").isin(*types)).select("vid", *[prop(p).alias(n) for n, p in names.items()])


def of(kind: str, key: str) -> str:
    """SQL id of an inventory vertex."""
    return f"({CODE[kind]}::BIGINT * 1000000000000000 + {key})"


# ---------------------------------------------------------------- values

VNF_TYPE = "CASE c_custkey % 4 WHEN 0 THEN 'HN' WHEN 1 THEN 'HP' WHEN 2 THEN 'HG' ELSE 'XX' END"


@query("m12_boolean_defaults", f"""
SELECT {of('generic-vnf', 'c_custkey')} AS vid, CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END AS closed, NULL AS base FROM customer
UNION ALL SELECT {of('vserver', 'c_custkey')}, 'false', NULL FROM customer
UNION ALL SELECT {of('vnfc', 'c_custkey')}, 'false', NULL FROM customer
UNION ALL SELECT {of('vf-module', 'c_custkey')}, NULL, 'false' FROM customer""")
def m12(spark, sf):
    v = values.boolean_defaults(inventory(spark, sf)).v
    return props(v, ["generic-vnf", "vserver", "vnfc", "vf-module"], closed="is-closed-loop-disabled", base="is-base-vf-module")


PORTS = """ports AS (SELECT s_suppkey AS s, k, s_suppkey * 10 + k AS pk, CASE WHEN k = 4 THEN 'ae4' ELSE '1.'||k END AS name
  FROM supplier, unnest([0,1,2,3,4]) u(k) WHERE NOT (k = 3 AND s_suppkey % 5 = 0))"""
SERVER_PORTS = "sp AS (SELECT c_custkey AS c, j FROM customer, unnest([0,1]) u(j) WHERE j = 0 OR c_custkey % 3 <> 0)"


@query("m13_in_maint_defaults", f"""
WITH {PORTS}, {SERVER_PORTS}
SELECT 'generic-vnf' AS node_type, count(*) AS n FROM customer UNION ALL SELECT 'l-interface', count(*) FROM customer
UNION ALL SELECT 'lag-interface', count(*) FROM ports WHERE k = 4
UNION ALL SELECT 'p-interface', (SELECT count(*) FROM ports WHERE k < 4) + (SELECT count(*) FROM sp)
UNION ALL SELECT 'vnfc', count(*) FROM customer UNION ALL SELECT 'vserver', count(*) FROM customer
UNION ALL SELECT 'pserver', count(*) FROM customer UNION ALL SELECT 'pnf', count(*) FROM supplier
UNION ALL SELECT 'cloud-region', count(*) FROM nation""")
def m13(spark, sf):
    return values.in_maint_defaults(inventory(spark, sf)).changed.groupBy("node_type").agg(F.count("*").alias("n"))


@query("m14_management_option", f"""
SELECT {of('generic-vnf', 'c_custkey')} AS vid, CASE WHEN c_custkey % 6 = 0 THEN 'own' WHEN {VNF_TYPE} <> 'XX' THEN 'Managed-Basic' END AS option
FROM customer""")
def m14(spark, sf):
    v = values.management_option(inventory(spark, sf), "Managed-Basic").v
    return props(v, ["generic-vnf"], option="management-option")


@query("m15_local_renames", f"""
SELECT {of('vnfc', 'c_custkey')} AS vid, 'inv'||c_custkey AS inv, CASE WHEN c_custkey % 3 = 0 THEN 'ver'||c_custkey END AS ver,
  NULL AS group_type, NULL AS group_role, NULL AS old FROM customer
UNION ALL SELECT {of('instance-group', 's_suppkey')}, 'inv'||s_suppkey, NULL, 't'||s_suppkey % 3, 'u'||s_suppkey % 2, NULL FROM supplier""")
def m15(spark, sf):
    v = values.local_renames(inventory(spark, sf)).v
    return props(v, ["vnfc", "instance-group"], inv="model-invariant-id-local", ver="model-version-id-local",
                 group_type="instance-group-type", group_role="instance-group-role", old="model-invariant-id")


@query("m16_normalise_equip_type", f"""
SELECT {of('pserver', 'c_custkey')} AS vid, CASE WHEN c_custkey % 2 = 0 THEN 'SERVER' ELSE 'VM' END AS kind FROM customer
UNION ALL SELECT {of('pnf', 's_suppkey')}, CASE WHEN s_suppkey % 3 < 2 THEN 'SWITCH' ELSE 'Router' END FROM supplier""")
def m16(spark, sf):
    return props(values.normalise_equip_type(inventory(spark, sf)).v, ["pserver", "pnf"], kind="equip-type")


HOST = """CASE WHEN c_custkey % 7 = 0 THEN 'nodot'||c_custkey ELSE 'h'||c_custkey // 4||'.'||
  CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'bb' WHEN 2 THEN 'ccc' ELSE 'dddd' END END"""


@query("m17_fqdn_from_hostname", f"""
SELECT {of('pserver', 'c_custkey')} AS vid, CASE WHEN c_custkey % 4 < 2 THEN 'h'||c_custkey // 4||'.fq'
  WHEN c_custkey % 7 <> 0 THEN {HOST} END AS fqdn FROM customer""")
def m17(spark, sf):
    return props(values.fqdn_from_hostname(inventory(spark, sf)).v, ["pserver"], fqdn="fqdn")


SRV = f"""srv AS MATERIALIZED (SELECT c_custkey AS c, c_custkey // 4 AS k, {HOST} AS host, c_custkey * 37 % 1000 AS rv,
  c_custkey % 4 < 2 AS rct FROM customer)"""
# Merging the servers of one source, as a chain of small tables.
SAME = f"""
{SRV}, {SERVER_PORTS},
pr AS MATERIALIZED (
  SELECT o.c AS old, n.c AS new, o.host AS oh, n.host AS nh FROM srv o JOIN srv n ON o.k = n.k AND o.c <> n.c
  WHERE o.rct AND n.rct AND (n.rv > o.rv OR (n.rv = o.rv AND n.c < o.c))),
pt AS MATERIALIZED (
  SELECT sp.c, sp.j, pr.new, oh, nh, x.c IS NOT NULL AS matched, pr.new % 5 <> 0 AS new_linked
  FROM sp LEFT JOIN pr ON pr.old = sp.c LEFT JOIN sp x ON x.c = pr.new AND x.j = sp.j),
ln AS (
  SELECT c, j, CASE WHEN new IS NULL THEN srv.host||':ge'||j||'|aa'||c||':1' ELSE 'aa'||c||':1|'||replace(srv.host||':ge'||j, oh, nh) END AS name
  FROM pt JOIN srv USING (c) WHERE c % 5 <> 0 AND NOT (new IS NOT NULL AND matched AND new_linked))"""


@query("m18_merge_same_source_servers", f"""
WITH {SAME}
SELECT {of('pserver', 'c')} AS vid, 'pserver' AS node_type, '/pservers/pserver/'||host AS uri, NULL AS link FROM srv WHERE c NOT IN (SELECT old FROM pr)
UNION ALL SELECT {of('server-port', 'c * 10 + j')}, 'p-interface',
  '/pservers/pserver/'||coalesce(nh, srv.host)||'/p-interfaces/p-interface/ge%2F'||j + 10, NULL
  FROM pt JOIN srv USING (c) WHERE new IS NULL OR NOT matched
UNION ALL SELECT {of('physical-link', 'c * 10 + j')}, 'physical-link', '/physical-link/'||c * 10 + j, name FROM ln
UNION ALL SELECT {of('l-interface', 'srv.c')}, 'l-interface',
  '/pservers/pserver/'||coalesce(nh, host)||'/p-interfaces/p-interface/ge%2F10/l-interfaces/l-interface/l'||srv.c, NULL
  FROM srv LEFT JOIN pr ON pr.old = srv.c""")
def m18(spark, sf):
    v = servers.merge_same_source(inventory(spark, sf), ["SRC-A"], "version").v
    kinds = ["pserver", "p-interface", "physical-link", "l-interface"]
    return v.where(F.col("node_type").isin(*kinds) & (F.floor(F.col("vid") / BASE) != CODE["port"])).select(
        "vid", "node_type", "uri", prop("link-name").alias("link"))


@query("m18_merge_longest_name", f"""
WITH {SRV}, tok AS (SELECT *, split_part(host, '.', 1) AS t FROM srv WHERE NOT rct),
win AS (SELECT t, arg_max(c, length(host) * 1000000000 - c) AS w FROM tok GROUP BY t)
SELECT {of('pserver', 'c')} AS vid FROM srv WHERE rct UNION ALL SELECT {of('pserver', 'w')} FROM win""")
def m18b(spark, sf):
    v = servers.merge_same_source(inventory(spark, sf), ["SRC-B"], "length").v
    return v.where("node_type = 'pserver'").select("vid")


CROSS = f"""
{SRV}, {SERVER_PORTS},
ro AS (SELECT split_part(host, '.', 1) AS t, min(c) AS old FROM srv WHERE NOT rct GROUP BY 1),
xp AS MATERIALIZED (
  SELECT ro.old, srv.c AS new, o.host AS oh, srv.c = min(srv.c) OVER (PARTITION BY ro.old) AS taker
  FROM srv JOIN ro ON t = 'h'||k JOIN srv o ON o.c = ro.old WHERE srv.rct)"""


@query("m19_merge_cross_source_servers", f"""
WITH {CROSS}
SELECT {of('pserver', 'srv.c')} AS vid, 'pserver' AS node_type, '/pservers/pserver/'||host AS uri,
  CASE WHEN xp.new IS NOT NULL THEN xp.oh WHEN rct THEN 'h'||k||'.fq' END AS fqdn
FROM srv LEFT JOIN xp ON xp.new = srv.c WHERE srv.c NOT IN (SELECT old FROM xp)
UNION ALL SELECT {of('server-port', 'sp.c * 10 + sp.j')}, 'p-interface',
  '/pservers/pserver/'||coalesce(n.host, s.host)||'/p-interfaces/p-interface/ge%2F'||sp.j + 10, NULL
FROM sp JOIN srv s ON s.c = sp.c LEFT JOIN xp ON xp.old = sp.c AND taker LEFT JOIN srv n ON n.c = xp.new
LEFT JOIN sp m ON m.c = xp.new AND m.j = sp.j WHERE m.c IS NULL""")
def m19(spark, sf):
    v = servers.merge_cross_source(inventory(spark, sf), ["SRC-A"], ["SRC-B"]).v
    return v.where(F.col("node_type").isin("pserver", "p-interface") & (F.floor(F.col("vid") / BASE) != CODE["port"])).select(
        "vid", "node_type", "uri", prop("fqdn").alias("fqdn"))


@query("m20_canonical_link_name", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN 's'||l_suppkey <= 'p'||l_partkey
  THEN 's'||l_suppkey||':'||l_linenumber||'|p'||l_partkey||':x' ELSE 'p'||l_partkey||':x|s'||l_suppkey||':'||l_linenumber END AS name FROM lineitem""")
def m20(spark, sf):
    li = table(spark, sf, "lineitem")
    name = text("s", F.col("l_suppkey"), ":", F.col("l_linenumber"), "|p", F.col("l_partkey"), ":x")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", values.canonical_link_name(name).alias("name"))


NP, NS = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM supplier)"


@query("m21_link_model_versions", f"""
SELECT {of('generic-vnf', 'c_custkey')} AS src, {of('model-ver', f'c_custkey % {NP}')} AS dst,
  CASE WHEN c_custkey % 4 = 0 THEN 'NONE' ELSE 'IN' END AS prevent_delete FROM customer
WHERE c_custkey % 4 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 10 <> 0)""")
def m21(spark, sf):
    e = models.link_model_versions(inventory(spark, sf)).e
    return e.where(F.floor(F.col("src") / BASE) == CODE["generic-vnf"]).where("label = 'IsA'").select("src", "dst", "prevent_delete")


@query("m21_unknown_versions", f"SELECT '/service-design-and-creation/models/model/inv'||c_custkey % {NP}||'/model-vers/model-ver/verX' AS line FROM customer WHERE c_custkey % 10 = 0")
def m21b(spark, sf):
    return models.link_model_versions(inventory(spark, sf)).fallout.select("line")


@query("m22_link_network_technologies", f"""
SELECT {of('cloud-region', 'n_nationkey')} AS src, {of('network-technology', "regexp_extract(b, '[0-9]+$')::BIGINT")} AS dst,
  'Uses' AS label, 'NONE' AS contains_other_v, 'NONE' AS delete_other_v, 'OUT' AS prevent_delete
FROM nation, (SELECT DISTINCT p_brand AS b FROM part)
WHERE (n_regionkey = 0 AND b IN ('Brand#1', 'Brand#2')) OR (n_regionkey = 1 AND b = 'Brand#3')""")
def m22(spark, sf):
    out = models.link_network_technologies(inventory(spark, sf), {"owner0": ["Brand#1", "Brand#2"], "owner1": ["Brand#3"]})
    return out.e.where(F.floor(F.col("dst") / BASE) == CODE["network-technology"]).select(
        "src", "dst", "label", "contains_other_v", "delete_other_v", "prevent_delete")


def valid_widgets(spark, sf) -> DataFrame:
    """The lowest part of each name is the valid model of it."""
    low = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p"))
    return low.select(F.col("p_name").alias("name"), text("ver", F.col("p")).alias("version_id"),
                      text("inv", F.col("p")).alias("invariant_id"))


LOW = "low AS (SELECT p_name, min(p_partkey) AS m FROM part GROUP BY 1), pl AS MATERIALIZED (SELECT p_partkey AS p, m FROM part JOIN low USING (p_name))"


@query("m23_swing_bad_models", f"""
WITH {LOW} SELECT {of('named-query-element', 'p')} AS src, {of('model', 'm')} AS dst FROM pl WHERE p % 4 = 0""")
def m23(spark, sf):
    e = models.swing_bad_models(inventory(spark, sf), valid_widgets(spark, sf)).e
    return e.where(F.floor(F.col("src") / BASE) == CODE["named-query-element"]).select("src", "dst")


@query("m24_swing_bad_versions", f"""
WITH {LOW}, bad AS (SELECT p FROM pl WHERE p % 2 = 0 AND p <> m AND p % 4 <> 0 AND p % 3 <> 0)
SELECT {of('model', 'p')} AS vid FROM pl WHERE p NOT IN (SELECT p FROM bad)
UNION ALL SELECT {of('model-ver', 'p')} FROM pl WHERE p NOT IN (SELECT p FROM bad)""")
def m24(spark, sf):
    v = models.swing_bad_versions(inventory(spark, sf), valid_widgets(spark, sf)).v
    return v.where(F.col("node_type").isin("model", "model-ver")).select("vid")


@query("m24_swung_version_edges", f"""
WITH {LOW}, isa AS (
  SELECT {of('generic-vnf', 'c_custkey')} AS src, c_custkey % {NP} AS p FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT {of('model-element', 'p_partkey')}, (p_partkey + 1) % {NP} FROM part WHERE p_partkey % 3 = 0)
SELECT src, {of('model-ver', 'CASE WHEN p % 2 = 0 THEN m ELSE p END')} AS dst FROM isa JOIN pl USING (p)""")
def m24b(spark, sf):
    e = models.swing_bad_versions(inventory(spark, sf), valid_widgets(spark, sf)).e
    return e.where((F.floor(F.col("dst") / BASE) == CODE["model-ver"]) & (F.col("label") == "IsA")).select("src", "dst")


@query("m25_module_edge_props", f"""
SELECT {of('vnfc', 'c_custkey')} AS src, {of('vf-module', 'c_custkey')} AS dst, 'OUT' AS delete_other_v, 'IN' AS prevent_delete FROM customer""")
def m25(spark, sf):
    e = values.module_edge_props(inventory(spark, sf)).e
    return e.where(F.floor(F.col("src") / BASE) == CODE["vnfc"]).select("src", "dst", "delete_other_v", "prevent_delete")


@query("m26_delete_follows_containment", graph_sql("""
SELECT eid, CASE WHEN contains_other_v = 'NONE' OR (s.node_type = 'nation' AND d.node_type = 'region') THEN delete_other_v ELSE contains_other_v END AS delete_other_v
FROM e LEFT JOIN v s ON s.vid = src LEFT JOIN v d ON d.vid = dst"""))
def m26(spark, sf):
    return values.delete_follows_containment(graph(spark, sf), ("nation", "region")).e.select("eid", "delete_other_v")


# Forwarders as (o, q, device, port): the sides of the evcs that have them.
FORWARDERS = f"""
sides AS (SELECT o_orderkey AS o, o_orderkey % {NS} AS s1, o_orderkey // 7 % 5 AS p1, (o_orderkey + 1) % {NS} AS s2, o_orderkey // 5 % 5 AS p2
  FROM orders),
fw AS MATERIALIZED (
  SELECT o, q, CASE q WHEN 1 THEN s1 ELSE s2 END AS s, CASE q WHEN 1 THEN p1 ELSE p2 END AS k FROM sides, unnest([1,2]) u(q)
  WHERE o % 11 <> 0 AND (o % 3 = 1 OR (o % 3 = 2 AND q = 1)))"""


@query("m27_unused_interfaces", f"""
WITH {PORTS}, {FORWARDERS}
SELECT {of('port', 'pk')} AS vid FROM ports WHERE k < 4 AND (k <> 2 OR EXISTS (SELECT 1 FROM fw WHERE fw.s = ports.s AND fw.k = 2))""")
def m27(spark, sf):
    v = values.unused_interfaces(inventory(spark, sf), "FEED").v
    return v.where((F.col("node_type") == "p-interface") & (F.floor(F.col("vid") / BASE) == CODE["port"])).select("vid")


# ---------------------------------------------------------------- feeds

@query("m28_licence_ids", f"""
WITH f AS (SELECT o_custkey AS c, o_orderkey % 5 AS g, min(o_orderkey) AS first FROM orders GROUP BY 1, 2),
lic AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 5 AS g, o_orderkey % 2 AS kind,
  count(*) OVER (PARTITION BY o_custkey, o_orderkey % 5, o_orderkey % 2) AS n FROM orders)
SELECT {of('licence', 'o')} AS vid, CASE WHEN n = 1 THEN 'new'||first ELSE 'r'||o END AS resource,
  '/vnfs/vnf'||c||'/licences/'||CASE WHEN n = 1 THEN 'new'||first ELSE 'r'||o END AS uri FROM lic JOIN f USING (c, g)""")
def m28(spark, sf):
    o = F.col("o_orderkey")
    feed = table(spark, sf, "orders").select(
        o.alias("line"), text("new", o).alias("resource_uuid"), text("g", o % 5).alias("group_uuid"),
        text("vnf", F.col("o_custkey")).alias("vnf_id"))
    v = feeds.licence_ids(inventory(spark, sf), feed).v
    return v.where(F.col("node_type").isin("entitlement", "license")).select(
        "vid", prop("resource-uuid").alias("resource"), "uri")


@query("m29_vendor_bandwidth", f"""
WITH f AS (SELECT p_partkey % 5 AS g, max(p_partkey) AS line, arg_max(p_size, p_partkey) AS bw FROM part GROUP BY 1)
SELECT {of('vnf-configuration', 'o_custkey')} AS vid, arg_max(bw, line)::VARCHAR AS bandwidth
FROM orders JOIN f ON g = o_orderkey % 5 WHERE o_orderkey % 2 = 0 AND o_custkey % 4 = 0 GROUP BY o_custkey""")
def m29(spark, sf):
    p = F.col("p_partkey")
    feed = table(spark, sf, "part").select(p.alias("line"), text("g", p % 5).alias("group_uuid"),
                                           F.col("p_size").cast("string").alias("bandwidth"))
    v = feeds.vendor_bandwidth(inventory(spark, sf), feed).v
    return props(v, ["configuration"], bandwidth="vendor-allowed-max-bandwidth").where("bandwidth IS NOT NULL")


def hub_feed(spark, sf):
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        o.alias("line"), text("evc", o).alias("evc"), text(o % 9).alias("ivlan"),
        F.when(o % 7 == 0, "99").otherwise(text(o % 50)).alias("svlan"))


@query("m30_hub_ivlans", f"""
WITH {FORWARDERS}
SELECT {of('forwarder-evc', 'o * 10 + q')} AS vid, CASE WHEN o % 13 <> 0 AND o % 7 <> 0 THEN (o % 9)::VARCHAR
  WHEN o % 5 = 0 THEN '7' END AS ivlan FROM fw""")
def m30(spark, sf):
    return props(feeds.hub_ivlans(inventory(spark, sf), hub_feed(spark, sf)).v, ["forwarder-evc"], ivlan="ivlan")


@query("m30_hub_fallout", f"""
WITH {FORWARDERS}
SELECT o_orderkey::VARCHAR AS line, 'no forwarder-evc' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT o FROM fw)
UNION ALL SELECT DISTINCT o::VARCHAR, 'no svlan' FROM fw WHERE o % 13 = 0""")
def m30b(spark, sf):
    return feeds.hub_ivlans(inventory(spark, sf), hub_feed(spark, sf)).fallout


def interconnects(spark, sf):
    o = F.col("o_orderkey")
    feed = table(spark, sf, "orders").select(o.alias("line"), text("evc", o).alias("evc"), F.col("o_orderpriority").alias("kind"))
    return feeds.interconnect_types(inventory(spark, sf), feed)


@query("m31_interconnect_types", f"""
SELECT {of('evc', 'o_orderkey')} AS vid, o_orderpriority AS kind FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 50 <> 0""")
def m31(spark, sf):
    return props(interconnects(spark, sf).v, ["evc"], kind="inter-connect-type-ingress").where("kind IS NOT NULL")


@query("m31_interconnect_fallout", """
SELECT o_orderkey::VARCHAR AS line, CASE WHEN o_orderstatus = 'P' THEN 'no such evc' ELSE 'more than one evc' END AS reason
FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 50 = 0""")
def m31b(spark, sf):
    return interconnects(spark, sf).fallout


@query("m32_physical_inventory", f"""
WITH {PORTS}, f AS (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN 'npnf' ELSE 'pnf' END||l_suppkey AS pnf, '1.'||l_linenumber AS port FROM lineitem)
SELECT 'pnf' AS node_type, '/network/pnfs/pnf/'||pnf AS uri FROM f WHERE pnf LIKE 'npnf%' GROUP BY pnf
UNION ALL SELECT 'p-interface', '/network/pnfs/pnf/'||pnf||'/p-interfaces/p-interface/'||port FROM f
WHERE (pnf, port) NOT IN (SELECT ('pnf'||s, name) FROM ports)""")
def m32(spark, sf):
    li = table(spark, sf, "lineitem")
    name = text(F.when(F.col("l_partkey") % 3 == 0, "npnf").otherwise("pnf"), F.col("l_suppkey"))
    feed = li.select(name.alias("pnf"), text("1.", F.col("l_linenumber")).alias("port"))
    out = feeds.physical_inventory(inventory(spark, sf), feed)
    return out.v.join(out.changed, "vid", "left_semi").select("node_type", "uri")


@query("m32_new_edges", f"""
WITH {PORTS}, f AS (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN 'npnf' ELSE 'pnf' END||l_suppkey AS pnf, '1.'||l_linenumber AS port FROM lineitem)
SELECT '/network/pnfs/pnf/'||pnf||'/p-interfaces/p-interface/'||port AS src_uri, '/network/pnfs/pnf/'||pnf AS dst_uri, 'BindsTo' AS label,
  'IN' AS contains_other_v, 'IN' AS delete_other_v, 'NONE' AS prevent_delete FROM f WHERE (pnf, port) NOT IN (SELECT ('pnf'||s, name) FROM ports)""")
def m32b(spark, sf):
    li = table(spark, sf, "lineitem")
    name = text(F.when(F.col("l_partkey") % 3 == 0, "npnf").otherwise("pnf"), F.col("l_suppkey"))
    g = inventory(spark, sf)
    out = feeds.physical_inventory(g, li.select(name.alias("pnf"), text("1.", F.col("l_linenumber")).alias("port")))
    at = lambda s: out.v.select(F.col("vid").alias(s), F.col("uri").alias(f"{s}_uri"))
    return new_edges(g, out).join(at("src"), "src").join(at("dst"), "dst").select(
        "src_uri", "dst_uri", "label", "contains_other_v", "delete_other_v", "prevent_delete")


def new_edges(g, out) -> DataFrame:
    return out.e.join(g.e.select("eid"), "eid", "left_anti")


def edge_kinds(g, out) -> DataFrame:
    """How many new edges there are of each label and rule values."""
    return new_edges(g, out).groupBy("label", "contains_other_v", "delete_other_v", "prevent_delete").agg(F.count("*").alias("n"))


def side_feed(spark, sf) -> DataFrame:
    """A line per evc with its two sides; every sixth evc has a second line on the next port of the bearer."""
    n_pnf = table(spark, sf, "supplier").count()
    o = F.col("o_orderkey")
    rows = order_ports(table(spark, sf, "orders"), n_pnf).select("*", F.explode(F.when(
        o % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    rows = rows.withColumn("p2", (F.col("p2") + F.col("again")) % 5)
    port = lambda p: F.when(F.col(p) == 4, "ae4_1").otherwise(port_name(F.col(p)))
    a = F.col("again")
    return rows.select(
        (o * 2 + a).alias("line"), text("evc", o).alias("evc"),
        text("pnf", F.col("s1")).alias("collector_pnf"), port("p1").alias("collector_port"),
        text("cc", o, "-", a).alias("collector_circuit"), text("1", o % 10).alias("collector_cvlan"), text("2", o % 10).alias("collector_svlan"),
        text("pnf", F.col("s2")).alias("bearer_pnf"), port("p2").alias("bearer_port"),
        text("bc", o, "-", a).alias("bearer_circuit"), text("3", o % 10).alias("bearer_cvlan"), text("4", o % 10).alias("bearer_svlan"),
        text(o % 1000, "Mbps").alias("rate"), text("esp", o).alias("esp_circuit"), F.lit("ESP").alias("esp_name"),
        F.lit("DOUBLE").alias("collector_tag"), F.lit("SINGLE").alias("bearer_tag"))


# Feed lines, then the ports of each evc in the order the lines name them.
SIDES = f"""
{FORWARDERS},
feed AS (SELECT o * 2 + a AS line, o, a, s1, p1, s2, (p2 + a) % 5 AS p2 FROM sides, unnest([0,1]) u(a) WHERE a = 0 OR o % 6 = 0),
okl AS MATERIALIZED (SELECT * FROM feed WHERE NOT (p1 = 3 AND s1 % 5 = 0) AND NOT (p2 = 3 AND s2 % 5 = 0))"""


@query("m33_path_forwarders", f"""
WITH {SIDES},
todo AS (SELECT * FROM okl WHERE o % 11 <> 0 AND o % 3 <> 1),
occ AS (SELECT o, line * 2 AS pos, a, s1 AS s, p1 AS k FROM todo UNION ALL SELECT o, line * 2 + 1, a, s2, p2 FROM todo),
pts AS (SELECT o, s, k, min(pos) AS pos, arg_max(a, pos) AS a FROM occ GROUP BY 1, 2, 3),
num AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY pos) AS seq FROM pts),
new AS (SELECT *, CASE WHEN seq = 1 THEN 'ingress' WHEN k < 4 THEN 'egress' ELSE 'intermediate' END AS role FROM num
  WHERE NOT EXISTS (SELECT 1 FROM fw WHERE fw.o = num.o AND fw.s = num.s AND fw.k = num.k))
SELECT 'evc'||o||'-'||seq AS id, CASE role WHEN 'ingress' THEN 'cc'||o||'-'||a WHEN 'egress' THEN 'bc'||o||'-'||a END AS circuit,
  CASE WHEN role = 'ingress' OR (role = 'intermediate' AND seq % 2 = 1) THEN '1' ELSE '3' END||o % 10 AS cvlan,
  CASE WHEN role = 'ingress' OR (role = 'intermediate' AND seq % 2 = 1) THEN '2' ELSE '4' END||o % 10 AS svlan
FROM new""")
def m33(spark, sf):
    g = inventory(spark, sf)
    v = feeds.path_forwarders(g, side_feed(spark, sf)).v
    new = v.where("node_type = 'forwarder-evc'").join(
        g.v.where("node_type = 'forwarder-evc'").select("vid"), "vid", "left_anti")
    return new.select(prop("forwarder-evc-id").alias("id"), prop("circuit-id").alias("circuit"), prop("cvlan").alias("cvlan"),
                      prop("svlan").alias("svlan"))


@query("m33_new_edges", f"""
WITH {SIDES},
todo AS (SELECT * FROM okl WHERE o % 11 <> 0 AND o % 3 <> 1),
occ AS (SELECT o, line * 2 AS pos, a, s1 AS s, p1 AS k FROM todo UNION ALL SELECT o, line * 2 + 1, a, s2, p2 FROM todo),
pts AS (SELECT o, s, k, min(pos) AS pos, arg_max(a, pos) AS a FROM occ GROUP BY 1, 2, 3),
num AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY pos) AS seq FROM pts),
new AS (SELECT *, CASE WHEN seq = 1 THEN 'ingress' WHEN k < 4 THEN 'egress' ELSE 'intermediate' END AS role FROM num
  WHERE NOT EXISTS (SELECT 1 FROM fw WHERE fw.o = num.o AND fw.s = num.s AND fw.k = num.k))
SELECT label, contains_other_v, delete_other_v, prevent_delete, times * (SELECT count(*) FROM new) AS n FROM (VALUES
  ('BelongsTo', 'IN', 'IN', 'NONE', 2), ('ForwardsTo', 'NONE', 'NONE', 'IN', 1), ('Uses', 'NONE', 'OUT', 'NONE', 1)
) k(label, contains_other_v, delete_other_v, prevent_delete, times)""")
def m33c(spark, sf):
    g = inventory(spark, sf)
    return edge_kinds(g, feeds.path_forwarders(g, side_feed(spark, sf)))


@query("m33_path_fallout", f"""
WITH {SIDES}
SELECT line::VARCHAR AS line, 'pnf or port does not exist' AS reason FROM feed WHERE line NOT IN (SELECT line FROM okl)
UNION ALL SELECT line::VARCHAR, 'forwarders exist' FROM okl WHERE o % 11 <> 0 AND o % 3 = 1
UNION ALL SELECT line::VARCHAR, 'no forwarding-path' FROM okl WHERE o % 11 = 0""")
def m33b(spark, sf):
    return feeds.path_forwarders(inventory(spark, sf), side_feed(spark, sf)).fallout


def services(spark, sf):
    return feeds.service_instances(inventory(spark, sf), side_feed(spark, sf), "G1", "TYPE-C")


@query("m34_service_instances", f"""
WITH {SIDES}, n AS (SELECT DISTINCT o FROM okl)
SELECT 'service-instance' AS node_type, count(*) AS n FROM n WHERE o % 17 <> 0
UNION ALL SELECT 'forwarding-path', count(*) FROM n WHERE NOT (o % 34 = 0 AND o % 11 <> 0)
UNION ALL SELECT 'configuration', count(*) FROM n UNION ALL SELECT 'evc', count(*) FROM n""")
def m34(spark, sf):
    g = inventory(spark, sf)
    new = services(spark, sf).v.select("vid", "node_type").join(g.v.select("vid"), "vid", "left_anti")
    return new.groupBy("node_type").agg(F.count("*").alias("n"))


@query("m34_new_edges", f"""
WITH {SIDES}, n AS (SELECT DISTINCT o FROM okl)
SELECT 'BelongsTo' AS label, 'IN' AS contains_other_v, 'IN' AS delete_other_v, 'NONE' AS prevent_delete,
  count(*) FILTER (o % 17 <> 0) + count(*) AS n FROM n
UNION ALL SELECT 'AppliesTo', 'NONE', 'NONE', 'IN', count(*) FROM n WHERE NOT (o % 34 = 0 AND o % 11 <> 0)
UNION ALL SELECT 'Uses', 'NONE', 'OUT', 'NONE', count(*) FROM n""")
def m34c(spark, sf):
    return edge_kinds(inventory(spark, sf), services(spark, sf))


@query("m34_new_evcs", f"""
WITH {SIDES} SELECT DISTINCT 'evc'||o AS evc, (o % 1000)::VARCHAR AS cir, 'Mbps' AS units, 'esp'||o AS circuit FROM okl""")
def m34b(spark, sf):
    g = inventory(spark, sf)
    new = services(spark, sf).v.where("node_type = 'evc'").join(g.v.where("node_type = 'evc'").select("vid"), "vid", "left_anti")
    return new.select(prop("evc-id").alias("evc"), prop("cir-value").alias("cir"), prop("cir-units").alias("units"),
                      prop("esp-evc-circuit-id").alias("circuit"))


@query("m35_tunnel_bandwidth", f"""
WITH {SERVER_PORTS}
SELECT {of('physical-link', 'c * 10 + j')} AS vid,
  CASE WHEN c % 2 = 0 AND (j = 0 OR c % 4 <> 0) THEN (c + 2 * j)::VARCHAR END AS up,
  CASE WHEN c % 2 = 0 AND (j = 0 OR c % 4 <> 0) THEN (c + 1 + 2 * j)::VARCHAR END AS down
FROM sp WHERE c % 5 <> 0""")
def m35(spark, sf):
    v = feeds.tunnel_bandwidth(inventory(spark, sf), "TYPE-A", "TYPE-B").v
    return props(v, ["physical-link"], up="service-provider-bandwidth-up-value", down="service-provider-bandwidth-down-value")


def circuit_feed(spark, sf):
    n_pnf = table(spark, sf, "supplier").count()
    o = F.col("o_orderkey")
    return order_ports(table(spark, sf, "orders"), n_pnf).select(
        o.alias("line"), text("pnf", F.col("s1")).alias("pnf"), port_name(F.col("p1")).alias("port"), text("c", o).alias("old"),
        F.when(o % 8 == 1, "").otherwise(text("n", o)).alias("new"))


AT_PORT = f"""
{FORWARDERS}, one AS MATERIALIZED (SELECT * FROM fw WHERE q = 1 AND NOT (k = 3 AND s % 5 = 0))"""


@query("m36_circuit_ids", f"""
WITH {AT_PORT}
SELECT {of('forwarder-evc', 'fw.o * 10 + fw.q')} AS vid, CASE WHEN fw.q = 2 OR fw.o % 4 = 0 THEN NULL
  WHEN one.o IS NOT NULL AND fw.o % 8 <> 1 THEN 'n'||fw.o ELSE 'c'||fw.o END AS circuit
FROM fw LEFT JOIN one ON one.o = fw.o AND one.q = fw.q""")
def m36(spark, sf):
    return props(feeds.circuit_ids(inventory(spark, sf), circuit_feed(spark, sf)).v, ["forwarder-evc"], circuit="circuit-id")


@query("m36_circuit_fallout", f"""
WITH {AT_PORT}, hot AS (SELECT DISTINCT s, k FROM one)
SELECT o::VARCHAR AS line, CASE WHEN hot.s IS NULL THEN 'no forwarder-evc' ELSE 'circuit id does not match' END AS reason
FROM sides LEFT JOIN hot ON hot.s = s1 AND hot.k = p1
WHERE hot.s IS NULL OR NOT (o % 8 <> 1 AND o % 4 <> 0 AND o IN (SELECT o FROM one))""")
def m36b(spark, sf):
    return feeds.circuit_ids(inventory(spark, sf), circuit_feed(spark, sf)).fallout


def ivlan_feed(spark, sf):
    """Every order names its first side; every ninth a device that is not there."""
    n_pnf = table(spark, sf, "supplier").count()
    o = F.col("o_orderkey")
    return order_ports(table(spark, sf, "orders"), n_pnf).select(
        o.alias("line"), text("evc", o).alias("evc"),
        F.when(o % 9 == 0, "gone").otherwise(text("pnf", F.col("s1"))).alias("pnf"), port_name(F.col("p1")).alias("port"),
        text(o % 90).alias("ivlan"))


@query("m37_port_ivlans", f"""
WITH {AT_PORT}
SELECT {of('forwarder-evc', 'fw.o * 10 + fw.q')} AS vid, CASE WHEN one.o IS NOT NULL AND fw.o % 9 <> 0 THEN (fw.o % 90)::VARCHAR
  WHEN fw.o % 5 = 0 THEN '7' END AS ivlan FROM fw LEFT JOIN one ON one.o = fw.o AND one.q = fw.q""")
def m37(spark, sf):
    return props(feeds.port_ivlans(inventory(spark, sf), ivlan_feed(spark, sf)).v, ["forwarder-evc"], ivlan="ivlan")


@query("m37_ivlan_fallout", f"""
WITH {AT_PORT}
SELECT o::VARCHAR AS line, CASE WHEN o % 9 = 0 THEN 'no pnf' ELSE 'no forwarder-evc' END AS reason FROM sides
WHERE o % 9 = 0 OR o NOT IN (SELECT o FROM one)""")
def m37b(spark, sf):
    return feeds.port_ivlans(inventory(spark, sf), ivlan_feed(spark, sf)).fallout


@query("m38_upgrade_cycles", f"""
WITH f AS (SELECT n_nationkey AS n, min(c_custkey) AS first FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT {of('cloud-region', 'n')} AS vid, 'cycle'||first AS cycle FROM f JOIN nation ON n_nationkey = n WHERE n_regionkey = 2""")
def m38(spark, sf):
    """Customers as feed rows naming their nation, odd nations by an alias only."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    odd = F.col("n_nationkey") % 2 == 1
    feed = rows.select(
        F.col("c_custkey").alias("line"), F.when(odd, text("long-", F.col("n_name"))).otherwise(F.col("n_name")).alias("region"),
        F.when(odd, F.col("n_name")).otherwise("").alias("alias"), text("cycle", F.col("c_custkey")).alias("cycle"))
    v = feeds.upgrade_cycles(inventory(spark, sf), feed, "owner2").v
    return props(v, ["cloud-region"], cycle="upgrade-cycle").where("cycle IS NOT NULL")


def changed_models(spark, sf):
    """VNF types HN and HP take the models of parts 1 and 4; every vf-module of customers asks for the version
    its model element uses and for the second image of its region."""
    c = F.col("c_custkey")
    cust = table(spark, sf, "customer")
    vnf_type = F.element_at(F.array(*[F.lit(x) for x in ("HN", "HP", "HG", "XX")]), (c % 4 + 1).cast("int"))
    p = F.col("p_partkey")
    base = table(spark, sf, "part").where("p_partkey IN (3, 4)")
    service = base.select(F.lit("service").alias("model_type"), F.when(p == 3, "HN").otherwise("HP").alias("vnf_type"),
                          text("inv", p).alias("inv"), text("ver", p).alias("ver"), F.lit("").alias("customization"),
                          F.lit("").alias("model_name"), F.lit("").alias("image"))
    resource = service.withColumn("model_type", F.lit("Resource")).withColumn("customization", F.lit("cust"))
    below = table(spark, sf, "part").select(p.alias("used"), F.col("p_name").alias("model_name"))
    module = cust.withColumn("used", F.lit(4).cast("long")).join(below, "used").select(
        text("vf", c).alias("model_type"), F.lit("").alias("vnf_type"), F.lit("").alias("inv"), F.lit("").alias("ver"), F.lit("").alias("customization"),
        "model_name", F.lit("img1").alias("image"))
    vnfs = cust.select(text("name", c).alias("vnf_name"), vnf_type.alias("vnf_type"))
    return models.change_models(inventory(spark, sf), service.unionByName(resource).unionByName(module), vnfs)


# The resource model of HN is part 3, whose element uses the version of part 4; that of HP has no element.
@query("m39_change_models", f"""
SELECT {of('generic-vnf', 'c_custkey')} AS vid, CASE c_custkey % 4 WHEN 0 THEN 'ver3' WHEN 1 THEN 'ver4' ELSE
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'verX' ELSE 'ver'||c_custkey % {NP} END END END AS ver,
  CASE c_custkey % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '1.1' END AS persona, CASE WHEN c_custkey % 4 < 2 THEN 'cust' END AS customization FROM customer
UNION ALL SELECT {of('service-instance', 'c_custkey')}, CASE c_custkey % 4 WHEN 0 THEN 'ver3' WHEN 1 THEN 'ver4' END,
  CASE c_custkey % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '1.1' END, NULL FROM customer
UNION ALL SELECT {of('vf-module', 'c_custkey')}, CASE c_custkey % 4 WHEN 0 THEN 'ver4' END, CASE c_custkey % 4 WHEN 0 THEN '1.1' END, NULL FROM customer""")
def m39(spark, sf):
    v = changed_models(spark, sf).v.where(F.floor(F.col("vid") / BASE).isin(
        CODE["generic-vnf"], CODE["service-instance"], CODE["vf-module"]))
    return v.select("vid", prop("model-version-id-local").alias("ver"), prop("persona-model-version").alias("persona"),
                    prop("model-customization-id").alias("customization"))


@query("m39_server_images", f"""
SELECT {of('vserver', 'c_custkey')} AS src, {of('image', 'c_nationkey * 10 + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END')} AS dst,
  CASE WHEN c_custkey % 4 = 0 THEN 'IN' ELSE 'NONE' END AS prevent_delete
FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 <> 0""")
def m39b(spark, sf):
    e = changed_models(spark, sf).e
    return e.where((F.floor(F.col("dst") / BASE) == CODE["image"]) & (F.col("label") == "Uses")).select("src", "dst", "prevent_delete")


def vlan_results(spark, sf) -> DataFrame:
    """A result per region and hundred orders, naming the orders as tags; written and read back as JSON."""
    o = F.col("o_orderkey")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(
        table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).where(o % 4 != 0)
    tag = F.struct(text("t", o).alias("vlan-tag-id"), F.col("o_orderpriority").alias("vlan-tag-role"),
                   (o % 2 == 0).alias("is-private"), o.alias("vlan-id-inner"))
    block = F.floor(o / 100)
    # at most a hundred orders share a result
    out = rows.groupBy("n_regionkey", "n_name", block.alias("b")).agg(F.collect_list(tag).alias("tags")).select(
        text("/inventory/v20/cloud-infrastructure/cloud-regions/cloud-region/owner", F.col("n_regionkey"), "/", F.col("n_name"), "/r").alias("url"),
        F.struct(text("range", F.col("b")).alias("vlan-range-id"), F.col("b").alias("vlan-id-lower"),
                 (F.col("b") + 99).alias("vlan-id-upper"), F.lit("x").alias("vlan-type"),
                 F.struct(F.col("tags").alias("vlan-tag")).alias("vlan-tags")).alias("vlan-range"))
    path = new_path(spark, "vlan")
    out.write.json(path)
    return feeds.read_vlan_results(spark, path)


@query("m40_vlan_tags", """
WITH t AS (SELECT o_orderkey AS o, n_regionkey AS r, n_name AS nm, o_orderkey // 100 AS b, o_orderpriority AS role, o_custkey AS c FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 4 <> 0 AND o_orderstatus = 'O')
SELECT 'vlan-tag' AS node_type, '/cloud-infrastructure/cloud-regions/cloud-region/owner'||r||'/'||nm||'/vlan-ranges/vlan-range/range'||b||'/vlan-tags/vlan-tag/t'||o AS uri,
  role, o::VARCHAR AS inner_id FROM t
UNION ALL SELECT DISTINCT 'vlan-range', '/cloud-infrastructure/cloud-regions/cloud-region/owner'||r||'/'||nm||'/vlan-ranges/vlan-range/range'||b, NULL, NULL FROM t
UNION ALL SELECT 'vlan-tag', '/vlan-tags/vlan-tag/t'||o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus = 'O'""")
def m40(spark, sf):
    v = feeds.vlan_tags(inventory(spark, sf), vlan_results(spark, sf)).v
    return v.where(F.col("node_type").isin("vlan-tag", "vlan-range")).select(
        "node_type", "uri", prop("vlan-tag-role").alias("role"), prop("vlan-id-inner").alias("inner_id"))


@query("m40_vlan_edges", f"""
SELECT 'Uses' AS label, 'NONE' AS contains_other_v, 'NONE' AS delete_other_v, 'NONE' AS prevent_delete, count(*) AS n FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'BelongsTo', 'IN', 'IN', 'NONE', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 <> 0) + (
  SELECT count(*) FROM (SELECT DISTINCT c_nationkey, o_orderkey // 100 FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderkey % 4 <> 0 AND o_orderstatus = 'O'))""")
def m40b(spark, sf):
    out = feeds.vlan_tags(inventory(spark, sf), vlan_results(spark, sf))
    mine = out.v.where(F.col("node_type").isin("vlan-tag", "vlan-range")).select(F.col("vid").alias("src"))
    kinds = ["label", "contains_other_v", "delete_other_v", "prevent_delete"]
    return out.e.join(mine, "src", "left_semi").groupBy(*kinds).agg(F.count("*").alias("n"))
