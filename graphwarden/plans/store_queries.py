"""Registered queries for uniqueness, schema, history and count audit, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.keys import prop
from graphwarden.operators import audit, history, schema_ops
from graphwarden.plans.oracle import graph_sql
from graphwarden.plans.registry import Registry
from graphwarden.plans.structure_queries import NOW_MS
from graphwarden.sources.tables import BASE, CLONE, bucketed_graph, graph

query = Registry()

PN = "pn AS (SELECT vid, node_type, props['part-name'] AS value FROM v WHERE props['part-name'] IS NOT NULL)"
PNC = "pnc AS (SELECT value, count(*) AS n FROM pn GROUP BY 1)"


@query("u1_unique_check", graph_sql("""
SELECT sum(n)::BIGINT AS times_found, sum(n - 1)::BIGINT AS extra_copies, count(*) FILTER (n > 1) AS repeated_values FROM pnc""",
                                    PN, PNC))
def u1(spark, sf):
    return schema_ops.unique_check(graph(spark, sf).v, "part-name")[0]


@query("u1_unique_check_groups", graph_sql(
    "SELECT value, vid, node_type, n AS n_nodes FROM pn JOIN pnc USING (value) WHERE n > 1", PN, PNC))
def u1b(spark, sf):
    return schema_ops.unique_check(graph(spark, sf).v, "part-name")[1]


@query("u2_unique_precheck", graph_sql("""
SELECT coalesce(sum(n - 1), 0)::BIGINT AS dupe_count, count(*) FILTER (n > 1) AS dupe_values
FROM (SELECT count(*) AS n FROM v WHERE props['name'] IS NOT NULL GROUP BY props['name'])"""))
def u2(spark, sf):
    return schema_ops.unique_precheck(graph(spark, sf).v, "name")


@query("u3_retype_property", graph_sql("""
SELECT vid, CASE WHEN try_cast(left(props['priority'], 2) AS INTEGER) IS NULL THEN NULL END AS priority,
  props['size']::INTEGER::VARCHAR AS size, NULL::VARCHAR AS line_status,
  props['priority'] AS retired FROM v"""))
def u3(spark, sf):
    """priority has no integer form and is kept as retired; size has; line-status is not preserved."""
    v = graph(spark, sf).v
    v, _ = schema_ops.retype_property(v, "priority", "Integer", date="20010802")
    v, _ = schema_ops.retype_property(v, "size", "Integer")
    v, _ = schema_ops.retype_property(v, "line-status", "Boolean", preserve=False)
    return v.select("vid", prop("priority").alias("priority"), prop("size").alias("size"),
                    prop("line-status").alias("line_status"), prop("priority-20010802-RETIRED").alias("retired"))


@query("u3_retype_failures", graph_sql(
    "SELECT vid, props['priority'] AS value FROM v WHERE props['priority'] IS NOT NULL"))
def u3b(spark, sf):
    return schema_ops.retype_property(graph(spark, sf).v, "priority", "Integer")[1]


EXPECTED = """
declared(node_type, name, type) AS (VALUES
  ('region', 'region-key', 'Long'), ('region', 'name', 'String'), ('nation', 'nation-key', 'Long'),
  ('nation', 'name', 'String'), ('customer', 'customer-key', 'Long'), ('customer', 'customer-name', 'String'),
  ('customer', 'market-segment', 'String'), ('supplier', 'supplier-key', 'Long'), ('supplier', 'supplier-name', 'String'),
  ('supplier', 'in-maint', 'Boolean'), ('part', 'part-key', 'Long'), ('part', 'part-name', 'String'),
  ('part', 'brand', 'String'), ('part', 'equip-type', 'String'), ('part', 'size', 'Integer'),
  ('order', 'order-key', 'Long'), ('order', 'order-status', 'String'), ('order', 'priority', 'String'),
  ('lineitem', 'line-number', 'Integer'), ('lineitem', 'quantity', 'Long'), ('lineitem', 'return-flag', 'String'),
  ('lineitem', 'line-status', 'String')),
seen AS (SELECT m.key AS name, count(*) AS n FROM v, unnest(map_entries(props)) x(m) GROUP BY 1)"""


@query("u4_expected_schema", graph_sql("""
SELECT DISTINCT d.name, type, 'SINGLE' AS cardinality, coalesce(n, 0) AS n_vertices
FROM declared d LEFT JOIN seen ON seen.name = d.name""", EXPECTED))
def u4(spark, sf):
    """Declared properties next to how many vertices carry them."""
    g = graph(spark, sf)
    seen = schema_ops.observed_properties(g.v).select("name", F.col("n").alias("n_vertices"))
    return schema_ops.expected_properties(g.nt).join(seen, "name", "left").fillna({"n_vertices": 0})


@query("u4_expected_indexes", graph_sql("""
SELECT index_name, is_unique, properties, count(v.vid) AS n_vertices
FROM (VALUES ('region-key', false, 'region-key'), ('nation-key', false, 'nation-key'), ('customer-key', false, 'customer-key'),
  ('supplier-key', false, 'supplier-key'), ('part-key', false, 'part-key'), ('part-name', false, 'part-name'),
  ('order-key', false, 'order-key'), ('order-status', false, 'order-status'), ('line-number', false, 'line-number'),
  ('key-for-region', false, 'node-type,region-key'), ('key-for-customer', false, 'node-type,customer-key'),
  ('key-for-supplier', false, 'node-type,supplier-key'), ('key-for-part', false, 'node-type,part-key'))
  i(index_name, is_unique, properties)
LEFT JOIN v ON props[string_split(properties, ',')[-1]] IS NOT NULL GROUP BY 1, 2, 3"""))
def u4b(spark, sf):
    """Declared indexes next to how many vertices they would hold (by their last property)."""
    g = graph(spark, sf)
    seen = schema_ops.observed_properties(g.v).select(F.col("name").alias("_last"), F.col("n").alias("n_vertices"))
    return schema_ops.expected_indexes(g.nt).withColumn(
        "_last", F.element_at(F.split("properties", ","), -1)).join(seen, "_last", "left").drop("_last").fillna(
        {"n_vertices": 0})


@query("u4_expected_labels", graph_sql("SELECT label, 'MULTI' AS multiplicity, count(*) AS n_edges FROM e GROUP BY 1"))
def u4c(spark, sf):
    g = graph(spark, sf)
    n = g.e.groupBy("label").agg(F.count("*").alias("n_edges"))
    return schema_ops.expected_labels(g.rules).join(n, "label")


@query("u5_schema_diff", graph_sql("""
SELECT coalesce(d.name, s.name) AS name, d.type, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing'
  WHEN d.type IS NULL THEN 'extra' WHEN d.name IN ('size', 'brand') THEN 'changed' ELSE 'ok' END AS status
FROM (SELECT DISTINCT name, type FROM declared WHERE node_type <> 'order') d FULL JOIN (
  SELECT m.key AS name, count(*) AS n FROM v, unnest(map_entries(props)) x(m)
  WHERE NOT (node_type = 'customer' AND m.key = 'market-segment') OR node_type IS NULL GROUP BY 1) s ON s.name = d.name""",
                                EXPECTED))
def u5(spark, sf):
    """Orders are undeclared, market segments lost, sizes turned into text and brands into lists."""
    g = graph(spark, sf)
    v = g.v.withColumn("props", F.map_filter("props", lambda k, _: k != "market-segment"))
    v = v.withColumn("props", F.transform_values("props", lambda k, x: F.when(
        k == "size", F.concat(x, F.lit(" cm"))).when(k == "brand", F.to_json(F.array(x, x))).otherwise(x)))
    return schema_ops.schema_diff(v, schema_ops.expected_properties(g.nt.where("node_type <> 'order'")))


@query("u5_label_diff", graph_sql("""
SELECT label, count(*) AS n, CASE label WHEN 'Uses' THEN 'extra' ELSE 'ok' END AS status FROM e GROUP BY 1"""))
def u5b(spark, sf):
    g = graph(spark, sf)
    return schema_ops.label_diff(g.e, g.rules.where("label <> 'Uses'"))


# ---------------------------------------------------------------- history

DAYS = 1500
CUTOFF = history.history_cutoff(NOW_MS, DAYS)


@query("h1_history_cutoff", f"""
SELECT CASE WHEN o_orderdate < make_timestamp({NOW_MS - DAYS * 86_400_000} * 1000) THEN 'history' ELSE 'current' END AS age,
  count(*) AS n FROM orders GROUP BY 1""")
def h1(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return orders.groupBy(F.when(ms < CUTOFF, "history").otherwise("current").alias("age")).agg(F.count("*").alias("n"))


@query("h2_truncate_counts", graph_sql(f"""
SELECT (SELECT count(*) FROM v WHERE end_ts < {CUTOFF}) AS n_vertices, (SELECT count(*) FROM e WHERE end_ts < {CUTOFF}) AS n_edges"""))
def h2(spark, sf):
    g = graph(spark, sf)
    return history.truncate_counts(g.v, g.e, CUTOFF)


def truncated(spark, sf):
    g = graph(spark, sf)
    return history.truncate_history(g.v, g.e, CUTOFF, history.DELETE_AND_LOG)


@query("h3_truncate_vertices", graph_sql(
    f"SELECT vid, node_type, end_ts FROM v WHERE end_ts IS NULL OR end_ts >= {CUTOFF}"))
def h3(spark, sf):
    return truncated(spark, sf)[0].select("vid", "node_type", "end_ts")


@query("h3_truncate_edges", graph_sql(f"""
SELECT eid, end_ts FROM e WHERE (end_ts IS NULL OR end_ts >= {CUTOFF}) AND NOT EXISTS (
  SELECT 1 FROM v WHERE vid IN (src, dst) AND v.end_ts < {CUTOFF})"""))
def h3b(spark, sf):
    return truncated(spark, sf)[1].select("eid", "end_ts")


@query("h3_truncate_log", graph_sql(f"""
SELECT 'edge' AS kind, eid AS id, end_ts FROM e WHERE end_ts < {CUTOFF}
UNION ALL SELECT 'vertex', vid::VARCHAR, end_ts FROM v WHERE end_ts < {CUTOFF}"""))
def h3c(spark, sf):
    return truncated(spark, sf)[2]


# ---------------------------------------------------------------- count audit

# Lines of neighbouring numbers share a uuid here, so URI and uuid claims form chains.
def claims(spark, sf) -> DataFrame:
    v = graph(spark, sf).v
    number = F.col("vid") % CLONE
    shared = F.md5(F.concat(F.lit("line:"), F.floor(number / 2).cast("string")).cast("binary"))
    order = (F.col("vid") - F.col("vid") % BASE + number) * 2 + F.when(F.col("vid") % BASE >= CLONE, 1).otherwise(0)
    return v.withColumn("uuid", F.when(F.col("node_type") == "lineitem", shared).otherwise(
        F.col("uuid"))).withColumn("line_no", order)


CLAIMS = """
claim AS MATERIALIZED (
  SELECT vid, node_type, uri, CASE WHEN node_type = 'lineitem' THEN md5('line:'||((vid % (5*10**14)::BIGINT) // 2)) ELSE uuid END AS uuid,
    (vid - vid % (10**15)::BIGINT + vid % (5*10**14)::BIGINT) * 2 + CASE WHEN vid % (10**15)::BIGINT >= (5*10**14)::BIGINT THEN 1 ELSE 0 END AS line_no
  FROM v WHERE node_type IS NOT NULL AND uri <> ''),
walked AS (
  SELECT *, lag(uri) OVER w AS puri, lag(uuid) OVER w AS puuid FROM claim WINDOW w AS (ORDER BY line_no)),
blocked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY block ORDER BY line_no) AS pos FROM (
    SELECT *, sum(CASE WHEN uri = puri OR uuid = puuid THEN 0 ELSE 1 END) OVER (ORDER BY line_no) AS block FROM walked)),
pass(block, pos, vid, node_type, ok, last_uri, last_uuid) AS (
  SELECT block, pos, vid, node_type, true, uri, uuid FROM blocked WHERE pos = 1
  UNION ALL
  SELECT b.block, b.pos, b.vid, b.node_type, b.uri <> p.last_uri AND b.uuid <> p.last_uuid,
    CASE WHEN b.uri <> p.last_uri AND b.uuid <> p.last_uuid THEN b.uri ELSE p.last_uri END,
    CASE WHEN b.uri <> p.last_uri AND b.uuid <> p.last_uuid THEN b.uuid ELSE p.last_uuid END
  FROM pass p JOIN blocked b ON b.block = p.block AND b.pos = p.pos + 1),
acc AS MATERIALIZED (SELECT vid, node_type FROM pass WHERE ok)"""
COUNTS = """
ncount AS (SELECT replace(node_type, '-', '_') AS table_name, count(*) AS n FROM acc GROUP BY 1),
ecount AS (
  SELECT CASE WHEN r.a IS NULL THEN 'edge__UNKNOWN' ELSE 'edge__'||r.a||'__'||r.b END AS table_name, count(*) AS n
  FROM (SELECT DISTINCT src, dst, label FROM e) x JOIN acc s ON s.vid = src JOIN acc d ON d.vid = dst
  LEFT JOIN (SELECT DISTINCT least(from_type, to_type) AS a, greatest(from_type, to_type) AS b FROM rules
             WHERE label <> 'LocatedIn') r
    ON r.a = least(s.node_type, d.node_type) AND r.b = greatest(s.node_type, d.node_type) GROUP BY 1)"""


def claim_sql(body: str, *ctes: str) -> str:
    return graph_sql(body, CLAIMS, COUNTS, *ctes, recursive=True)


_accepted: dict[tuple, DataFrame] = {}


def accepted(spark, sf) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _accepted:
        rows = audit.accept_vertices(claims(spark, sf), graph(spark, sf).nt, "line_no")
        _accepted[key] = audit.cut(rows.select("vid", "node_type"), "accepted")
    return _accepted[key]


def some_rules(spark, sf):
    """Rules without the cousin edges to nations, so those count as unknown."""
    return graph(spark, sf).rules.where("label <> 'LocatedIn'")


@query("a1_accept_vertices", claim_sql("SELECT vid, node_type FROM acc"))
def a1(spark, sf):
    return audit.accept_vertices(claims(spark, sf), graph(spark, sf).nt, "line_no").select("vid", "node_type")


@query("a2_node_counts", claim_sql("SELECT table_name, n FROM ncount"))
def a2(spark, sf):
    return audit.node_counts(accepted(spark, sf))


@query("a3_edge_tables", graph_sql("""
SELECT t.table_name, count(x.eid) AS n_edges FROM (
  SELECT DISTINCT 'edge__'||least(from_type, to_type)||'__'||greatest(from_type, to_type) AS table_name FROM rules
  WHERE from_type <> 'part' AND to_type <> 'part') t
LEFT JOIN (SELECT eid, 'edge__'||least(s.node_type, d.node_type)||'__'||greatest(s.node_type, d.node_type) AS table_name
  FROM e JOIN v s ON s.vid = src JOIN v d ON d.vid = dst) x USING (table_name) GROUP BY 1"""))
def a3(spark, sf):
    """Edge table names without the undeclared part type, with the edges that belong to each."""
    g = graph(spark, sf)
    names = audit.edge_tables(g.rules, g.nt.where("node_type <> 'part'"))
    ends = g.v.select("vid", "node_type")
    rows = g.e.select("eid", "src", "dst").join(ends.toDF("src", "a"), "src").join(ends.toDF("dst", "b"), "dst")
    n = rows.groupBy(audit._pair(F.col("a"), F.col("b")).alias("table_name")).agg(F.count("*").alias("n_edges"))
    return names.join(n, "table_name", "left").fillna({"n_edges": 0})


@query("a4_edge_counts", claim_sql("SELECT table_name, n FROM ecount"))
def a4(spark, sf):
    g = graph(spark, sf)
    return audit.edge_counts(g.e, accepted(spark, sf), some_rules(spark, sf), g.nt)


@query("a4_edge_counts_bucketed", query.sql["a4_edge_counts"])
def a4b(spark, sf):
    b = bucketed_graph(spark, sf)
    return audit.edge_counts(b.out, accepted(spark, sf), some_rules(spark, sf), b.nt)


def all_counts(spark, sf) -> DataFrame:
    g = graph(spark, sf)
    nodes = accepted(spark, sf)
    return audit.node_counts(nodes).unionByName(audit.edge_counts(g.e, nodes, some_rules(spark, sf), g.nt))


def store_counts(spark, sf) -> DataFrame:
    """The other store: row counts of the source tables."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    tables = {"customer": read("customer"), "order": read("orders"), "lineitem": read("lineitem"), "part": read("part"),
              "edge__customer__order": read("orders"), "document": read("documents")}
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    # the other store has a region table without rows
    empty = counted[0].select(F.lit("region").alias("table_name"), F.lit(0).cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [*counted, empty])


STORE = """
other AS (
  SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM orders
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part
  UNION ALL SELECT 'region', 0 UNION ALL SELECT 'edge__customer__order', count(*) FROM orders
  UNION ALL SELECT 'document', count(*) FROM documents),
mine AS (SELECT * FROM ncount UNION ALL SELECT * FROM ecount)"""


@query("a5_compare_counts", claim_sql("""
SELECT coalesce(m.table_name, o.table_name) AS table_name, m.n AS n_left, o.n AS n_right,
  CASE WHEN o.n IS NULL THEN 'only in left' WHEN m.n IS NULL THEN 'only in right'
    WHEN m.n > 0 AND o.n = 0 THEN 'zero in right' WHEN m.n = o.n THEN 'equal' ELSE 'different' END AS status
FROM mine m FULL JOIN other o ON o.table_name = m.table_name""", STORE))
def a5(spark, sf):
    return audit.compare_counts(all_counts(spark, sf), store_counts(spark, sf))


@query("a6_totals", claim_sql("""
SELECT sum(CASE WHEN table_name NOT LIKE 'edge\\_\\_%' ESCAPE '\\' THEN n END)::BIGINT AS nodes,
  sum(CASE WHEN table_name LIKE 'edge\\_\\_%' ESCAPE '\\' THEN n END)::BIGINT AS edges FROM mine""", STORE))
def a6(spark, sf):
    return audit.totals(all_counts(spark, sf))


@query("a7_snapshot_ts", """
WITH names AS (SELECT event_id, 'dataSnapshot.graphson.'||CASE WHEN event_type = 'error' THEN strftime(ts, '%Y%m%d')
  ELSE strftime(ts, '%Y%m%d%H%M') END AS name FROM events)
SELECT event_id, CASE WHEN regexp_matches(name, '\\.[0-9]{12}$') THEN epoch_ms(strptime(right(name, 12), '%Y%m%d%H%M')) END AS snapshot_ms
FROM names""")
def a7(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    stamp = F.when(F.col("event_type") == "error", F.date_format(ts, "yyyyMMdd")).otherwise(
        F.date_format(ts, "yyyyMMddHHmm"))
    name = F.concat(F.lit("dataSnapshot.graphson."), stamp)
    return ev.select("event_id", F.unix_millis(audit.snapshot_ts(name)).alias("snapshot_ms"))
