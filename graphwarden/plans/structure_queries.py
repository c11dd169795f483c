"""Registered queries for filters and structure, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphwarden.functions.keys import prop
from graphwarden.operators import filters, structure as st
from graphwarden.plans.oracle import graph_sql
from graphwarden.plans.registry import Registry
from graphwarden.sources.tables import BASE, CODES, bucketed_graph, graph

NOW_MS = 996_710_400_000  # fixed clock: 2001-08-02
MONTHS_6 = 6 * 30 * 24 * 60
query = Registry()


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


START = NOW_MS - MONTHS_6 * 60_000


@query("f1_window_filter_mod", graph_sql(
    f"SELECT node_type, count(*) AS n, max(vid) AS last_vid FROM v WHERE last_mod_ts IS NULL OR last_mod_ts >= {START} GROUP BY 1"))
def f1(spark, sf):
    v = filters.window_filter_mod(graph(spark, sf).v, NOW_MS, MONTHS_6)
    return v.groupBy("node_type").agg(F.count("*").alias("n"), F.max("vid").alias("last_vid"))


@query("f2_window_filter_created", graph_sql(
    f"SELECT node_type, count(*) AS n, max(vid) AS last_vid FROM v WHERE created_ts IS NULL OR created_ts > {START} GROUP BY 1"))
def f2(spark, sf):
    v = filters.window_filter_created(graph(spark, sf).v, NOW_MS, MONTHS_6)
    return v.groupBy("node_type").agg(F.count("*").alias("n"), F.max("vid").alias("last_vid"))


@query("f3_filter_props", graph_sql(
    "SELECT vid, uri FROM v WHERE props['order-status'] = 'F' AND props['priority'] = '1-URGENT'"))
def f3(spark, sf):
    return filters.filter_props(graph(spark, sf).v, "order-status|F,priority|1-URGENT").select("vid", "uri")


@query("f4_lookup_by_keys", graph_sql("""
SELECT vid, uri, n_events FROM v JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) k
  ON props['customer-key'] = user_id::VARCHAR WHERE node_type = 'customer'"""))
def f4(spark, sf):
    keys = events(spark, sf).groupBy(F.col("user_id").cast("string").alias("key:customer-key")).agg(
        F.count("*").alias("n_events"))
    return filters.lookup_by_keys(graph(spark, sf).v, "customer", keys).select("vid", "uri", "n_events")


@query("f5_filter_regex", graph_sql("""
SELECT vid, props['part-name'] AS part_name FROM v WHERE node_type = 'part'
  AND regexp_full_match(props['part-name'], '(small|large) .*') AND regexp_full_match(props['brand'], 'Brand#[1-3]')"""))
def f5(spark, sf):
    v = filters.filter_regex(graph(spark, sf).v, "part",
                             {"part-name": "(small|large) .*", "brand": "Brand#[1-3]"})
    return v.select("vid", prop("part-name").alias("part_name"))


@query("f6_only_type", graph_sql("SELECT vid, uri, uuid FROM v WHERE node_type = 'order'"))
def f6(spark, sf):
    return filters.only_type(graph(spark, sf).v, "order").select("vid", "uri", "uuid")


def id_texts(spark, sf):
    return events(spark, sf).select(F.explode(F.array(
        F.col("user_id").cast("string"),
        (F.col("user_id") + CODES["customer"] * BASE).cast("string"),
        F.col("event_type"))).alias("id"))


IDS = """ids AS (SELECT unnest([user_id::VARCHAR, (user_id + 3*10**15::BIGINT)::BIGINT::VARCHAR, event_type]) AS id FROM events)"""


@query("f7_read_id_list", graph_sql("""
SELECT CASE WHEN regexp_full_match(id, '[0-9]+') THEN id::BIGINT END AS vid,
  CASE WHEN NOT regexp_full_match(id, '[0-9]+') THEN id END AS rejected, count(*) AS n FROM ids GROUP BY 1, 2""", IDS))
def f7(spark, sf):
    good, bad = filters.read_id_list(id_texts(spark, sf))
    return good.select("vid", F.lit(None).cast("string").alias("rejected")).unionByName(
        bad.select(F.lit(None).cast("long").alias("vid"), F.col("id").alias("rejected"))
    ).groupBy("vid", "rejected").agg(F.count("*").alias("n"))


@query("f8_touch_report", graph_sql("""
SELECT DISTINCT id, CASE WHEN NOT regexp_full_match(id, '[0-9]+') THEN 'bad_id' WHEN v.vid IS NULL THEN 'not_found'
  WHEN props['customer-key'] IS NULL THEN 'no_property' ELSE 'updatable' END AS status
FROM ids LEFT JOIN v ON v.vid = try_cast(id AS BIGINT)""", IDS))
def f8(spark, sf):
    return filters.touch_report(graph(spark, sf).v, id_texts(spark, sf), "customer-key")


@query("f9_missing_or_empty", graph_sql(
    "SELECT vid, uri FROM v WHERE node_type = 'customer' AND coalesce(props['customer-key'], '') = ''"))
def f9(spark, sf):
    return filters.missing_or_empty(graph(spark, sf).v, "customer", "customer-key").select("vid", "uri")


@query("j1_tree", graph_sql("SELECT parent_vid, child_vid FROM tree"))
def j1(spark, sf):
    return st.tree(graph(spark, sf).e).select("parent_vid", "child_vid")


@query("j2_parents", graph_sql("""
SELECT vid, node_type, count(child_vid) AS n_parents, min(parent_vid) AS first_parent, max(parent_vid) AS last_parent
FROM v LEFT JOIN tree ON child_vid = vid GROUP BY 1, 2"""))
def j2(spark, sf):
    g = graph(spark, sf)
    return st.parents(g.v, g.e)


@query("j2_parents_bucketed", query.sql["j2_parents"])
def j2b(spark, sf):
    return st.bucketed_parents(bucketed_graph(spark, sf))


@query("j3_children", graph_sql("""
SELECT parent_vid, vid, props['order-status'] AS status FROM tree JOIN v ON vid = child_vid WHERE node_type = 'order'"""))
def j3(spark, sf):
    g = graph(spark, sf)
    return st.children(g.v, g.e, "order").select("parent_vid", "vid", prop("order-status").alias("status"))


@query("j4_neighbours", graph_sql(
    "SELECT vid, count(*) AS n, min(other_vid) AS low, max(other_vid) AS high FROM nb GROUP BY 1"))
def j4(spark, sf):
    return st.neighbours(graph(spark, sf).e).groupBy("vid").agg(
        F.count("*").alias("n"), F.min("other_vid").alias("low"), F.max("other_vid").alias("high"))


@query("j4_neighbours_bucketed", graph_sql(
    "SELECT vid, count(*) AS n, min(other_vid) AS low, max(other_vid) AS high FROM nb WHERE vid IN (SELECT vid FROM v) GROUP BY 1"))
def j4b(spark, sf):
    return st.bucketed_neighbours(bucketed_graph(spark, sf))


@query("j5_cousins", graph_sql("""
SELECT nb.vid, other_vid, o.node_type AS other_type FROM nb JOIN e USING (eid) JOIN v o ON o.vid = other_vid
WHERE contains_other_v = 'NONE'"""))
def j5(spark, sf):
    g = graph(spark, sf)
    return st.cousins(g.v, g.e).select("vid", "other_vid", "other_type")


@query("j6_ancestors", graph_sql(
    "SELECT vid, min(depth) AS depth, ancestor_vid FROM anc GROUP BY 1, 3",
    """anc(vid, depth, ancestor_vid) AS (
  SELECT child_vid, 1, parent_vid FROM tree JOIN v ON vid = child_vid
  UNION SELECT a.vid, a.depth + 1, t.parent_vid FROM anc a JOIN tree t ON t.child_vid = a.ancestor_vid)""",
    recursive=True))
def j6(spark, sf):
    g = graph(spark, sf)
    return st.ancestors(g.v, g.e)


@query("j7_count_descendants", graph_sql("""
SELECT v.vid, coalesce(n, 0) AS n_descendants FROM v LEFT JOIN
 (SELECT root, count(*) AS n FROM walk WHERE depth > 0 GROUP BY 1) w ON root = vid""",
    """walk(root, depth, node) AS (
  SELECT vid, 0, vid FROM v
  UNION ALL SELECT root, depth + 1, child_vid FROM walk JOIN tree ON parent_vid = node WHERE depth < 15)""",
    recursive=True))
def j7(spark, sf):
    g = graph(spark, sf)
    return st.count_descendants(g.e, g.v)


@query("j8_count_edges", graph_sql(
    "SELECT v.vid, count(nb.vid) AS n_edges FROM v LEFT JOIN nb ON nb.vid = v.vid GROUP BY 1"))
def j8(spark, sf):
    g = graph(spark, sf)
    return st.count_edges(g.e, g.v)


@query("j9_has_edge", graph_sql("""
SELECT a, b FROM (SELECT DISTINCT (3*10**15 + o_custkey)::BIGINT AS a, (6*10**15 + o_orderkey)::BIGINT AS b FROM orders) p
WHERE EXISTS (SELECT 1 FROM e WHERE dst = a AND src = b AND label = 'BelongsTo')"""))
def j9(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    pairs = orders.select((F.col("o_custkey") + CODES["customer"] * BASE).alias("a"),
                          (F.col("o_orderkey") + CODES["order"] * BASE).alias("b"))
    return st.has_edge(pairs, graph(spark, sf).e, "IN", "BelongsTo")


@query("j10_edge_detail", graph_sql("""
SELECT n.vid, n.dir, n.label, n.other_vid, o.node_type AS other_type, o.vid IS NOT NULL AS other_found
FROM (SELECT src AS vid, 'OUT' AS dir, label, dst AS other_vid FROM e UNION ALL SELECT dst, 'IN', label, src FROM e) n
LEFT JOIN v o ON o.vid = n.other_vid WHERE n.vid IN (SELECT vid FROM v)"""))
def j10(spark, sf):
    g = graph(spark, sf)
    return st.edge_detail(g.v, g.e, g.v).drop("eid", "contains_other_v")


NAMES = """nm AS (SELECT vid, CASE WHEN coalesce(uri, '') = '' THEN concat_ws('-', vid, node_type) ELSE uri END AS nm FROM v)"""


@query("j11_edge_report", graph_sql("""
SELECT e.eid, o.nm||'|'||label||'|'||i.nm||'|'||contains_other_v AS line
FROM e JOIN nm o ON o.vid = src JOIN nm i ON i.vid = dst""", NAMES))
def j11(spark, sf):
    g = graph(spark, sf)
    return st.edge_report(g.v, g.e)[0]


@query("j11_vertices_without_uri", graph_sql("SELECT vid, node_type FROM v WHERE coalesce(uri, '') = ''"))
def j11b(spark, sf):
    g = graph(spark, sf)
    return st.edge_report(g.v, g.e)[1]
