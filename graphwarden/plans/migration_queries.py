"""Registered queries for the generic migrations, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.bounds import one_row
from graphwarden.functions.keys import prop
from graphwarden.functions.storage import new_path
from graphwarden.functions.versions import VersionedStore
from graphwarden.operators import migrate
from graphwarden.operators.filters import only_type
from graphwarden.operators.structure import tree
from graphwarden.plans.oracle import graph_sql
from graphwarden.plans.registry import Registry
from graphwarden.plans.structure_queries import NOW_MS
from graphwarden.sources.tables import BASE, CLONE, CODES, bucketed_graph, graph

query = Registry()


@query("m1_fill_values", graph_sql("""
SELECT vid, CASE WHEN node_type = 'supplier' THEN coalesce(props['in-maint'], 'false')
                 WHEN node_type = 'part' THEN 'false' ELSE props['in-maint'] END AS in_maint,
  CASE WHEN node_type = 'customer' THEN coalesce(props['customer-key'], '-1') ELSE props['customer-key'] END AS customer_key FROM v"""))
def m1(spark, sf):
    v, _ = migrate.fill_values(graph(spark, sf).v, {
        "supplier": {"in-maint": "false"}, "part": {"in-maint": "false"}, "customer": {"customer-key": "-1"}})
    return v.select("vid", prop("in-maint").alias("in_maint"), prop("customer-key").alias("customer_key"))


@query("m1_fill_values_conditional", graph_sql("""
SELECT vid, node_type, 'size' AS "key", '0' AS value FROM v
WHERE node_type = 'part' AND (props['brand'] IN ('Brand#1', 'Brand#2') OR props['equip-type'] = 'ECONOMY')"""))
def m1b(spark, sf):
    return migrate.fill_values(graph(spark, sf).v, {"part": {"size": "0"}},
                               {"brand": ["Brand#1", "Brand#2"], "equip-type": ["ECONOMY"]}, True)[1]


@query("m2_rename_property", graph_sql("""
SELECT vid, CASE WHEN node_type = 'region' THEN props['name'] END AS region_name,
  CASE WHEN node_type <> 'region' THEN props['name'] END AS name, cardinality(props)::INTEGER AS n_props FROM v"""))
def m2(spark, sf):
    v, _ = migrate.rename_property(graph(spark, sf).v, "name", "region-name", ["region"])
    return v.select("vid", prop("region-name").alias("region_name"), prop("name").alias("name"),
                    F.size("props").alias("n_props"))


@query("m3_reset_edge_props", graph_sql("""
SELECT eid, e.contains_other_v, CASE WHEN s.node_type IN ('order', 'lineitem') AND d.node_type IN ('customer', 'order')
  THEN 'IN' ELSE e.delete_other_v END AS delete_other_v, e.prevent_delete
FROM e LEFT JOIN v s ON s.vid = src LEFT JOIN v d ON d.vid = dst"""))
def m3(spark, sf):
    g = graph(spark, sf)
    e, _ = migrate.reset_edge_props(g.e, g.v, [("order", "customer"), ("order", "lineitem")], g.rules)
    return e.select("eid", "contains_other_v", "delete_other_v", "prevent_delete")


@query("m3_unknown_labels", graph_sql("""
SELECT eid FROM e JOIN v s ON s.vid = src JOIN v d ON d.vid = dst WHERE d.node_type = 'nation' AND s.node_type = 'customer'"""))
def m3b(spark, sf):
    """No rule knows the cousin edges once their label is gone from the rules."""
    g = graph(spark, sf)
    return migrate.reset_edge_props(g.e, g.v, [("nation", "customer")], g.rules.where("label <> 'LocatedIn'"))[1]


REBUILD = """
typed AS (SELECT e.*, s.node_type AS st, d.node_type AS dt FROM e LEFT JOIN v s ON s.vid = src LEFT JOIN v d ON d.vid = dst),
ruled AS MATERIALIZED (
  SELECT t.*, r.delete_other_v AS rd, r.label IS NOT NULL AS known,
    row_number() OVER (PARTITION BY src, st, dt, t.label, r.label IS NOT NULL ORDER BY eid) AS rn
  FROM typed t LEFT JOIN rules r ON r.from_type = st AND r.to_type = dt)"""


@query("m4_rebuild_edges", graph_sql("""
SELECT eid, src, dst, label, contains_other_v, rd AS delete_other_v FROM ruled WHERE known AND rn = 1""", REBUILD))
def m4(spark, sf):
    g = graph(spark, sf)
    e, _ = migrate.rebuild_edges(g.e, g.v, g.rules)
    return e.select("eid", "src", "dst", "label", "contains_other_v", "delete_other_v")


@query("m4_rebuild_edges_bucketed", query.sql["m4_rebuild_edges"])
def m4c(spark, sf):
    b = bucketed_graph(spark, sf)
    e, _ = migrate.rebuild_edges(b.out, b.v, b.rules)
    return e.select("eid", "src", "dst", "label", "contains_other_v", "delete_other_v")


@query("m4_rebuild_report", graph_sql("""
SELECT eid, CASE WHEN st IS NULL OR dt IS NULL THEN 'missing end' ELSE 'multiplicity' END AS reason
FROM ruled WHERE NOT known OR rn > 1""", REBUILD))
def m4b(spark, sf):
    g = graph(spark, sf)
    return migrate.rebuild_edges(g.e, g.v, g.rules)[1]


def clone_pairs(spark, sf) -> DataFrame:
    """(old, new): cloned parts go back to their original."""
    clones = only_type(graph(spark, sf).v, "part").where(F.col("vid") >= CODES["part"] * BASE + CLONE)
    return clones.select(F.col("vid").alias("old"), (F.col("vid") - CLONE).alias("new"))


SWING = """
half AS (SELECT (5*10**15 + 5*10**14)::BIGINT AS base, (5*10**14)::BIGINT AS shift),
moved AS (
  SELECT 'swung:'||eid AS eid, src, n.vid AS dst FROM e JOIN v o ON o.vid = dst JOIN v n
    ON n.vid = CASE WHEN o.vid % 2 = 0 THEN o.vid + 1 ELSE NULL END
  WHERE o.node_type = 'part' AND n.node_type = 'part' AND o.vid < (SELECT base FROM half) AND label = 'Uses'
    AND NOT EXISTS (SELECT 1 FROM e x WHERE x.dst = n.vid AND x.src = e.src))"""


@query("m5_swing_edges", graph_sql("""
SELECT eid, src, dst FROM e WHERE NOT (label = 'Uses' AND dst % 2 = 0 AND EXISTS (
    SELECT 1 FROM v n WHERE n.vid = dst + 1 AND n.node_type = 'part') AND dst < (SELECT base FROM half)
    AND EXISTS (SELECT 1 FROM v o WHERE o.vid = dst AND o.node_type = 'part'))
UNION ALL SELECT eid, src, dst FROM moved""", SWING))
def m5(spark, sf):
    """Every even part hands its line edges to the odd part after it."""
    g = graph(spark, sf)
    parts = only_type(g.v, "part").where(F.col("vid") < CODES["part"] * BASE + CLONE).select("vid")
    pairs = parts.where(F.col("vid") % 2 == 0).select(F.col("vid").alias("old"), (F.col("vid") + 1).alias("new"))
    e, _ = migrate.swing_edges(g.e, g.v, pairs, "lineitem", "Uses", "IN")
    return e.select("eid", "src", "dst")


@query("m5_swing_back_clones", graph_sql("""
SELECT eid, src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM v WHERE vid = dst AND node_type = 'part' AND vid >= (5*10**15 + 5*10**14)::BIGINT)"""))
def m5b(spark, sf):
    """The originals know all neighbours of their clones, so the edges only vanish."""
    g = graph(spark, sf)
    return migrate.swing_edges(g.e, g.v, clone_pairs(spark, sf))[0].select("eid", "src", "dst")


def order_pairs(spark, sf) -> DataFrame:
    """The lowest order of a customer takes in the highest one."""
    g = graph(spark, sf)
    one = tree(g.e).groupBy("child_vid").agg(F.count("*").alias("n"), F.min("parent_vid").alias("parent_vid")).where("n = 1")
    kids = one.join(only_type(g.v, "order").select(F.col("vid").alias("child_vid")), "child_vid", "left_semi")
    ends = kids.groupBy("parent_vid").agg(F.min("child_vid").alias("primary"), F.max("child_vid").alias("secondary"))
    return ends.where("primary <> secondary").select("primary", "secondary")


MERGE = """
single AS (SELECT child_vid, min(parent_vid) AS parent_vid FROM tree GROUP BY 1 HAVING count(*) = 1),
opair AS MATERIALIZED (
  SELECT min(child_vid) AS pri, max(child_vid) AS sec FROM single JOIN v ON vid = child_vid WHERE node_type = 'order'
  GROUP BY parent_vid HAVING count(*) > 1),
kid AS (SELECT parent_vid, child_vid, props['line-number'] AS k FROM tree JOIN v ON vid = child_vid WHERE node_type = 'lineitem'),
lpair AS MATERIALIZED (
  SELECT s.child_vid AS sec, min(p.child_vid) AS pri FROM opair JOIN kid s ON s.parent_vid = sec
  JOIN kid p ON p.parent_vid = pri AND p.k = s.k GROUP BY 1),
mp AS MATERIALIZED (SELECT sec, pri FROM opair UNION ALL SELECT sec, pri FROM lpair),
te AS MATERIALIZED (
  SELECT e.*, a.pri AS nsrc, b.pri AS ndst FROM e LEFT JOIN mp a ON a.sec = src LEFT JOIN mp b ON b.sec = dst),
cz AS (
  SELECT coalesce(nsrc, src) AS src, coalesce(ndst, dst) AS dst, label, contains_other_v FROM te
  WHERE contains_other_v = 'NONE' AND (nsrc IS NOT NULL OR ndst IS NOT NULL)),
me AS MATERIALIZED (
  SELECT src, dst, label FROM te WHERE nsrc IS NULL AND ndst IS NULL
  UNION ALL SELECT src, ndst, label FROM te WHERE contains_other_v = 'IN' AND nsrc IS NULL AND ndst IS NOT NULL
  UNION ALL SELECT DISTINCT cz.src, cz.dst, label FROM cz WHERE NOT EXISTS (
    SELECT 1 FROM te x WHERE x.nsrc IS NULL AND x.ndst IS NULL AND x.src = cz.src AND x.dst = cz.dst AND x.contains_other_v = 'NONE'))"""


def merged(spark, sf):
    g = graph(spark, sf)
    return migrate.merge_vertices(g.v, g.e, g.nt, order_pairs(spark, sf), {"order": ["priority"]})


@query("m6_merge_vertices", graph_sql("""
SELECT v.vid, v.node_type, coalesce(s.props['priority'], v.props['priority']) AS priority, v.props['order-status'] AS status
FROM v LEFT JOIN opair ON pri = v.vid LEFT JOIN v s ON s.vid = sec WHERE v.vid NOT IN (SELECT sec FROM mp)""", MERGE))
def m6(spark, sf):
    return merged(spark, sf)[0].select("vid", "node_type", prop("priority").alias("priority"),
                                       prop("order-status").alias("status"))


@query("m6_merge_edges", graph_sql("SELECT src, dst, label FROM me", MERGE))
def m6b(spark, sf):
    return merged(spark, sf)[1].select("src", "dst", "label")


@query("m6_merge_chains", graph_sql("""
SELECT node AS secondary, keeper AS "primary" FROM grp JOIN (
  SELECT low, coalesce(min(node) FILTER (node NOT IN (SELECT sec FROM pr)), min(node)) AS keeper FROM grp GROUP BY low) USING (low)
WHERE node <> keeper""", """
pr AS MATERIALIZED (
  SELECT (3*10**15 + c_custkey)::BIGINT AS sec, (3*10**15 + c_custkey - 1)::BIGINT AS pri FROM customer WHERE c_custkey % 25 > 1
  UNION ALL SELECT (3*10**15 + c_custkey - 22)::BIGINT, (3*10**15 + c_custkey)::BIGINT FROM customer WHERE c_custkey % 75 = 23)""",
    "two AS MATERIALIZED (SELECT sec AS a, pri AS b FROM pr UNION SELECT pri, sec FROM pr)",
    "reach AS (SELECT DISTINCT a AS node, a AS low FROM two UNION SELECT b, low FROM reach JOIN two ON a = node WHERE low < b)",
    "grp AS MATERIALIZED (SELECT node, min(low) AS low FROM reach GROUP BY node)", recursive=True))
def m6c(spark, sf):
    """Chains of customers, each to be merged into the one before; every third chain is closed to a cycle."""
    c, at = spark.read.parquet(f"{sf}/customer.parquet"), F.col("c_custkey").cast("long")
    vid = lambda k: (k + CODES["customer"] * BASE)
    chains = c.where(at % 25 > 1).select(vid(at).alias("secondary"), vid(at - 1).alias("primary"))
    return migrate.merge_targets(chains.unionByName(c.where(at % 75 == 23).select(vid(at - 22).alias("secondary"), vid(at).alias("primary"))))


@query("m7_create_edges", graph_sql("""
SELECT 'BelongsTo:'||o.vid||':'||c.vid AS eid, o.vid AS src, c.vid AS dst, 'IN' AS contains_other_v FROM orders
JOIN v o ON o.vid = (6*10**15 + o_orderkey)::BIGINT JOIN v c ON c.vid = (3*10**15 + o_custkey)::BIGINT
WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = o.vid AND dst = c.vid)"""))
def m7(spark, sf):
    """The missing parent edges of the orders come back."""
    g = graph(spark, sf)
    pairs = spark.read.parquet(f"{sf}/orders.parquet").select(
        (F.col("o_custkey") + CODES["customer"] * BASE).alias("a"), (F.col("o_orderkey") + CODES["order"] * BASE).alias("b"))
    return migrate.create_edges(pairs, g.v, g.e, g.rules, migrate.TREE)[0].select("eid", "src", "dst", "contains_other_v")


URIS = """
top AS (SELECT v.vid, CASE node_type WHEN 'region' THEN '/regions/region/' WHEN 'customer' THEN '/customers/customer/'
    WHEN 'supplier' THEN '/suppliers/supplier/' ELSE '/parts/part/' END||props[key_prop] AS uri
  FROM v JOIN nt USING (node_type) WHERE top_level),
up AS (SELECT child_vid AS vid, min(t.uri) AS uri FROM tree JOIN top t ON t.vid = parent_vid WHERE t.uri IS NOT NULL GROUP BY 1),
mid AS (SELECT v.vid, up.uri||CASE node_type WHEN 'nation' THEN '/nations/nation/'||props['nation-key']
    ELSE '/orders/order/'||props['order-key'] END AS uri FROM v JOIN up USING (vid)),
up2 AS (SELECT child_vid AS vid, min(t.uri) AS uri FROM tree JOIN mid t ON t.vid = parent_vid GROUP BY 1),
low AS (SELECT v.vid, up2.uri||'/lineitems/lineitem/'||props['line-number'] AS uri FROM v JOIN up2 USING (vid)),
fresh AS (SELECT * FROM top WHERE uri IS NOT NULL UNION ALL SELECT * FROM mid UNION ALL SELECT * FROM low)"""


@query("m8_rebuild_uris", graph_sql("SELECT vid, node_type, coalesce(f.uri, v.uri) AS uri FROM v LEFT JOIN fresh f USING (vid)", URIS))
def m8(spark, sf):
    g = graph(spark, sf)
    return migrate.rebuild_uris(g.v, g.e, g.nt)[0].select("vid", "node_type", "uri")


def registry() -> list[migrate.Migration]:
    """Three small migrations for the ledger run; the disabled one runs only when named."""
    def fill(g):
        v, changed = migrate.fill_values(g.v, {"supplier": {"in-maint": "false"}})
        return migrate.Outcome(v, g.e, changed)

    def rename(g):
        v, changed = migrate.rename_property(g.v, "in-maint", "maintained")
        return migrate.Outcome(v, g.e, changed)

    def broken(g):
        v, changed = migrate.fill_values(g.v, {"part": {"brand": "none"}}, None, True)
        return migrate.Outcome(v, g.e, changed, changed.select(F.col("vid").cast("string").alias("line"),
                                                               F.lit("overwrites").alias("reason")), migrate.CHECK_LOGS)

    return [migrate.Migration("rename-maint", rename, 20), migrate.Migration("fill-maint", fill, 10),
            migrate.Migration("reset-brands", broken, 30), migrate.Migration("off", rename, 5, False)]


def ledger_run(spark, sf):
    g = graph(spark, sf)
    ledger = spark.createDataFrame([("older",)], "name string")
    return migrate.run_migrations(spark, g, registry(), ledger, migrate.Options(commit=True, now_ms=NOW_MS))


@query("m9_run_migrations", graph_sql(f"""
SELECT vid, CASE WHEN node_type = 'supplier' THEN coalesce(props['in-maint'], 'false') ELSE props['in-maint'] END AS maintained,
  NULL::VARCHAR AS in_maint, props['brand'] AS brand,
  CASE WHEN node_type = 'supplier' OR props['in-maint'] IS NOT NULL THEN {NOW_MS} ELSE last_mod_ts END AS last_mod_ts,
  CASE WHEN node_type = 'supplier' OR props['in-maint'] IS NOT NULL THEN '{NOW_MS}' ELSE resource_version END AS resource_version
FROM v"""))
def m9(spark, sf):
    """Fill, then rename, are committed in priority order; the one with an anomaly is rolled back."""
    v = ledger_run(spark, sf)[0].v
    return v.select("vid", prop("maintained").alias("maintained"), prop("in-maint").alias("in_maint"),
                    prop("brand").alias("brand"), "last_mod_ts", "resource_version")


@query("m9_versions", graph_sql(f"""
SELECT version::BIGINT AS version, n_ledger::BIGINT AS n_ledger, count(*) AS n_vertices,
  count(*) FILTER (CASE WHEN version = 3 THEN false WHEN version = 2 THEN node_type = 'supplier' OR props['in-maint'] IS NOT NULL ELSE props['in-maint'] IS NOT NULL END) AS n_in_maint,
  count(*) FILTER (version = 3 AND (node_type = 'supplier' OR props['in-maint'] IS NOT NULL)) AS n_maintained, (SELECT count(*) FROM e) AS n_edges
FROM v, (VALUES (1, 0), (2, 1), (3, 2), (4, 0)) n(version, n_ledger) GROUP BY version, n_ledger"""))
def m9c(spark, sf):
    """The same run on a versioned store: the graph as each version has it, the last one rolled back to the first."""
    g = graph(spark, sf)
    store = VersionedStore(spark, new_path(spark, "store"))
    store.commit(0, {"vertices": g.v, "edges": g.e}, (), migrate.PARTITIONED)
    migrate.run_versioned(store, g.nt, g.rules, registry(), migrate.Options(commit=True, now_ms=NOW_MS))
    store.roll_back(1)
    counts = []
    for n in store.versions():
        v = store.read("vertices", n).agg(
            F.count("*").alias("n_vertices"), F.count(prop("in-maint")).alias("n_in_maint"), F.count(prop("maintained")).alias("n_maintained"))
        row = one_row(v, store.read("edges", n).agg(F.count("*").alias("n_edges")))
        counts.append(row.select(
            F.lit(n).cast("long").alias("version"), F.lit(len(store.manifest(n)["ledger"])).cast("long").alias("n_ledger"),
            "n_vertices", "n_in_maint", "n_maintained", "n_edges"))
    return reduce(DataFrame.unionByName, counts)


@query("m9_events", graph_sql(f"""
SELECT 'fill-maint' AS name, vid, {NOW_MS}::BIGINT AS ts, '{NOW_MS}' AS version FROM v WHERE node_type = 'supplier' AND props['in-maint'] IS NULL
UNION ALL SELECT 'rename-maint', vid, {NOW_MS}, '{NOW_MS}' FROM v WHERE node_type = 'supplier' OR props['in-maint'] IS NOT NULL"""))
def m9b(spark, sf):
    """Change rows of the committed migrations."""
    parts = [o.events.select(F.lit(n).alias("name"), "vid", "ts", "version") for n, o in ledger_run(spark, sf)[3] if o.events is not None]
    return reduce(DataFrame.unionByName, parts)


@query("m10_migration_summary", graph_sql("""
SELECT 'fill-maint' AS name, 'SUCCESS' AS status, count(*) AS n_changed, 0 AS n_fallout FROM v WHERE node_type = 'supplier' AND props['in-maint'] IS NULL
UNION ALL SELECT 'rename-maint', 'SUCCESS', count(*), 0 FROM v WHERE node_type = 'supplier' OR props['in-maint'] IS NOT NULL
UNION ALL SELECT 'reset-brands', 'CHECK_LOGS', count(*), count(*) FROM v WHERE node_type = 'part'"""))
def m10(spark, sf):
    return migrate.migration_summary(spark, ledger_run(spark, sf)[3])


@query("m11_touch", graph_sql(f"""
SELECT vid, CASE WHEN user_id IS NULL THEN last_mod_ts ELSE {NOW_MS} END AS last_mod_ts,
  CASE WHEN user_id IS NULL THEN resource_version ELSE '{NOW_MS}' END AS resource_version
FROM v LEFT JOIN (SELECT DISTINCT user_id FROM events) ON vid = (3*10**15 + user_id)::BIGINT"""))
def m11(spark, sf):
    ids = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") + CODES["customer"] * BASE).alias("vid"))
    return migrate.touch(graph(spark, sf).v, ids, NOW_MS).select("vid", "last_mod_ts", "resource_version")
