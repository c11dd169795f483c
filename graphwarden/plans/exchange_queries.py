"""Registered queries for traversal, snapshots, feeds, payloads and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphwarden.functions.keys import prop
from graphwarden.functions.storage import new_path, written
from graphwarden.functions.versions import VersionedStore
from graphwarden.operators import payload, traverse as tr
from graphwarden.operators.filters import only_type
from graphwarden.plans.oracle import graph_sql
from graphwarden.plans.registry import Registry
from graphwarden.plans.structure_queries import NOW_MS
from graphwarden.sources import feeds, id_map, snapshot as snap
from graphwarden.sources.tables import BASE, CODES, graph

query = Registry()


def start(spark, sf, node_type):
    return tr.seed(graph(spark, sf), node_type)


# ---------------------------------------------------------------- traversal

TYPED = """
c AS (SELECT * FROM v WHERE node_type = 'customer'), o AS (SELECT * FROM v WHERE node_type = 'order'),
l AS (SELECT * FROM v WHERE node_type = 'lineitem'), p AS (SELECT * FROM v WHERE node_type = 'part'),
co AS (SELECT c.vid AS cv, o.vid AS ov, c.props AS cp, o.props AS op FROM c JOIN tree ON parent_vid = c.vid JOIN o ON o.vid = child_vid),
ol AS (SELECT o.vid AS ov, l.vid AS lv FROM o JOIN tree ON parent_vid = o.vid JOIN l ON l.vid = child_vid),
lp AS (SELECT l.vid AS lv, p.vid AS pv FROM l JOIN e ON src = l.vid AND label = 'Uses' JOIN p ON p.vid = dst)"""


def t_sql(body: str, *ctes: str) -> str:
    return graph_sql(body, TYPED, *ctes)


@query("t1_seed", t_sql("SELECT vid FROM c"))
def t1(spark, sf):
    return start(spark, sf, "customer").result()


@query("t2_has", t_sql("SELECT vid FROM c WHERE props['market-segment'] IN ('BUILDING', 'MACHINERY')"))
def t2(spark, sf):
    return start(spark, sf, "customer").has("market-segment", "BUILDING", "MACHINERY").result()


@query("t3_has_not", t_sql("SELECT vid FROM c WHERE props['customer-key'] IS DISTINCT FROM '7'"))
def t3(spark, sf):
    return start(spark, sf, "customer").has_not("customer-key", 7).result()


@query("t4_to", t_sql("""
SELECT pv AS vid, count(*) AS n FROM co JOIN ol USING (ov) JOIN lp USING (lv) WHERE cp['market-segment'] = 'BUILDING' GROUP BY 1"""))
def t4(spark, sf):
    hop = start(spark, sf, "customer").has("market-segment", "BUILDING").to("order").to("lineitem").to("part")
    return hop.rows().groupBy("vid").agg(F.sum("n").cast("long").alias("n"))


@query("t5_union", t_sql("""
SELECT cv AS vid, count(*) AS n FROM co WHERE op['order-status'] = 'F' GROUP BY 1
UNION ALL SELECT lv, count(*) FROM ol JOIN o ON o.vid = ov WHERE props['order-status'] = 'F' GROUP BY 1"""))
def t5(spark, sf):
    q = start(spark, sf, "order").has("order-status", "F").union(
        lambda t: t.to("customer"), lambda t: t.to("lineitem"))
    return q.rows().select("vid", F.col("n").cast("long").alias("n"))


@query("t6_where", t_sql("SELECT vid FROM c WHERE vid IN (SELECT cv FROM co WHERE op['priority'] = '1-URGENT')"))
def t6(spark, sf):
    return start(spark, sf, "customer").where(lambda t: t.to("order").has("priority", "1-URGENT")).result()


@query("t7_store", t_sql("""
SELECT vid FROM c WHERE props['market-segment'] = 'BUILDING'
UNION SELECT lv FROM co JOIN ol USING (ov) WHERE cp['market-segment'] = 'BUILDING' AND op['order-status'] = 'P'"""))
def t7(spark, sf):
    return start(spark, sf, "customer").has("market-segment", "BUILDING").store().to("order").has(
        "order-status", "P").to("lineitem").store().vertices()


@query("t8_limit", t_sql("SELECT pv AS vid FROM co JOIN ol USING (ov) JOIN lp USING (lv) ORDER BY pv LIMIT 100"))
def t8(spark, sf):
    return start(spark, sf, "customer").to("order").to("lineitem").to("part").limit(100).result()


@query("t8_limit_of_stored", t_sql("SELECT vid FROM c UNION SELECT ov FROM co ORDER BY vid LIMIT 50"))
def t8b(spark, sf):
    return start(spark, sf, "customer").store().to("order").store().limit(50).result()


@query("t2_has_boolean", t_sql("SELECT vid FROM v WHERE node_type = 'supplier' AND props['in-maint'] = 'true'"))
def t2b(spark, sf):
    return start(spark, sf, "supplier").has("in-maint", True).result()


@query("t9_count", t_sql("SELECT count(*) AS n FROM co JOIN ol USING (ov) JOIN lp USING (lv)"))
def t9(spark, sf):
    return start(spark, sf, "customer").to("order").to("lineitem").to("part").count()


PICKED = "picked AS MATERIALIZED (SELECT DISTINCT ov AS vid FROM co WHERE cp['market-segment'] = 'BUILDING' UNION SELECT vid FROM c WHERE props['market-segment'] = 'BUILDING')"


def picked(spark, sf) -> DataFrame:
    q = start(spark, sf, "customer").has("market-segment", "BUILDING").store().to("order").store()
    return written(q.vertices(), "picked")



@query("t10_subgraph_star_edges", t_sql("SELECT eid FROM e SEMI JOIN picked ON src = vid UNION SELECT eid FROM e SEMI JOIN picked ON dst = vid", PICKED))
def t10(spark, sf):
    return tr.subgraph(graph(spark, sf), picked(spark, sf), "star")[1].select("eid")


@query("t10_subgraph_star_vertices", t_sql("""
SELECT vid, node_type FROM v SEMI JOIN (SELECT vid FROM picked UNION SELECT dst FROM e SEMI JOIN picked ON src = vid
  UNION SELECT src FROM e SEMI JOIN picked ON dst = vid) near USING (vid)""", PICKED))
def t10b(spark, sf):
    return tr.subgraph(graph(spark, sf), picked(spark, sf), "star")[0].select("vid", "node_type")


@query("t11_subgraph_prune_edges", t_sql("SELECT eid FROM e SEMI JOIN picked a ON src = a.vid SEMI JOIN picked b ON dst = b.vid", PICKED))
def t11(spark, sf):
    return tr.subgraph(graph(spark, sf), picked(spark, sf), "prune")[1].select("eid")


@query("t11_subgraph_prune_vertices", t_sql("""
SELECT vid, node_type FROM v SEMI JOIN (
  SELECT unnest([src, dst]) AS vid FROM e SEMI JOIN picked a ON src = a.vid SEMI JOIN picked b ON dst = b.vid) ends USING (vid)""", PICKED))
def t11b(spark, sf):
    return tr.subgraph(graph(spark, sf), picked(spark, sf), "prune")[0].select("vid", "node_type")


@query("t12_result_list", t_sql("SELECT pv AS vid FROM co JOIN ol USING (ov) JOIN lp USING (lv) WHERE op['priority'] = '1-URGENT'"))
def t12(spark, sf):
    return start(spark, sf, "customer").to("order").has("priority", "1-URGENT").to("lineitem").to("part").result()


# ---------------------------------------------------------------- snapshots

_snapshots: dict[tuple, str] = {}


def snapshot_path(spark, sf, partial: bool = False) -> str:
    """A snapshot of the derived graph (or of its customers and orders), written once per session."""
    key = (spark.sparkContext.applicationId, sf, partial)
    if key not in _snapshots:
        g = graph(spark, sf)
        v = snap.filter_snapshot_types(g.v, ["customer", "order"]) if partial else g.v
        n_files = snap.snapshot_file_count(v.count(), 8)
        _snapshots[key] = snap.write_snapshot(v, g.e, new_path(spark, "snapshot"), n_files, "inv-", compression="gzip")
    return _snapshots[key]


def vertex_view(v: DataFrame) -> DataFrame:
    return v.select("vid", "node_type", "uri", "uuid", "resource_version", "created_ts", "last_mod_ts", "end_ts",
                    "source_of_truth", prop("customer-name").alias("customer_name"), prop("order-key").alias("order_key"),
                    prop("quantity").alias("quantity"), prop("brand").alias("brand"), F.size("props").alias("n_props"))


VIEW = """vid, node_type, uri, uuid, resource_version, created_ts, last_mod_ts, end_ts, source_of_truth,
  props['customer-name'] AS customer_name, props['order-key'] AS order_key, props['quantity'] AS quantity,
  props['brand'] AS brand, cardinality(props)::INTEGER AS n_props"""
EDGE_VIEW = ["eid", "src", "dst", "label", "contains_other_v", "delete_other_v", "prevent_delete", "end_ts"]
IN_FILE = "EXISTS (SELECT 1 FROM v s WHERE s.vid = src) AND EXISTS (SELECT 1 FROM v d WHERE d.vid = dst)"


@query("s1_read_snapshot", graph_sql(f"SELECT {VIEW} FROM v"))
def s1(spark, sf):
    return vertex_view(snap.read_snapshot(spark, snapshot_path(spark, sf), "inv-")[0])


@query("s3_write_snapshot", graph_sql(f"SELECT {', '.join(EDGE_VIEW)} FROM e"))
def s3(spark, sf):
    return snap.read_snapshot(spark, snapshot_path(spark, sf), "inv-")[1].select(*EDGE_VIEW)


@query("s3_whole_lines", graph_sql("""
SELECT v.vid, 1::BIGINT AS n_lines, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, out_edges, in_edges, own, v.uri
FROM v LEFT JOIN o USING (vid) LEFT JOIN i USING (vid) LEFT JOIN p USING (vid)""",
    "o AS (SELECT src AS vid, count(*) AS n_out, md5(string_agg(eid||'>'||dst||':'||label, ',' ORDER BY eid||'>'||dst||':'||label)) AS out_edges FROM e GROUP BY 1)",
    "i AS (SELECT dst AS vid, count(*) AS n_in, md5(string_agg(eid||'<'||src||':'||label, ',' ORDER BY eid||'<'||src||':'||label)) AS in_edges FROM e GROUP BY 1)",
    "p AS (SELECT vid, md5(string_agg(m.key||'='||m.value, ',' ORDER BY m.key)) AS own FROM (SELECT vid, unnest(map_entries(props)) AS m FROM v) GROUP BY 1)"))
def s3b(spark, sf):
    """Each vertex as a plain reader of one JSON object per line finds it: its edges, properties and number of lines."""
    def edges(side, other, arrow):
        found = F.flatten(F.map_values(F.transform_values(side, lambda label, list_: F.transform(
            list_, lambda x: F.concat(x["id"], F.lit(arrow), x[other].cast("string"), F.lit(":"), label)))))
        return F.md5(F.array_join(F.array_sort(found), ",").cast("binary")), F.size(found).cast("long")

    lines = spark.read.text(snapshot_path(spark, sf)).where(F.trim("value") != "").select(F.inline(F.array(F.from_json("value", snap.LINE_DDL))))
    (out_edges, n_out), (in_edges, n_in) = edges(F.col("outE"), "inV", ">"), edges(F.col("inE"), "outV", "<")
    names = [*["inv-" + n for n in snap.STORE_NAMES.values()], *snap.PLAIN_NAMES.values()]
    own = F.array_sort(F.map_entries(F.map_filter("properties", lambda k, _: ~k.isin(*names))))
    own = F.transform(own, lambda m: F.concat(m["key"], F.lit("="), m["value"][0]["value"]))
    # what is told of a line goes to its count, not the line
    facts = lines.select(
        F.col("id").alias("vid"), F.when(F.col("outE").isNull(), 0).otherwise(n_out).alias("n_out"),
        F.when(F.col("inE").isNull(), 0).otherwise(n_in).alias("n_in"), out_edges.alias("out_edges"), in_edges.alias("in_edges"),
        F.when(F.size(own) > 0, F.md5(F.array_join(own, ",").cast("binary"))).alias("own"), F.col("properties")["inv-uri"][0]["value"].alias("uri")).where("vid IS NOT NULL")
    return facts.select("vid", F.count("*").over(Window.partitionBy("vid")).alias("n_lines"), *facts.columns[1:])


@query("s2_read_partial_snapshot", graph_sql(f"""
SELECT {', '.join(EDGE_VIEW)} FROM e WHERE src IN (SELECT vid FROM v WHERE node_type IN ('customer', 'order'))
  AND dst IN (SELECT vid FROM v WHERE node_type IN ('customer', 'order'))"""))
def s2(spark, sf):
    return snap.read_partial_snapshot(spark, snapshot_path(spark, sf, True), "inv-")[1].select(*EDGE_VIEW)


@query("s1_unreadable_lines", graph_sql("SELECT vid FROM v WHERE vid % 50 = 0"))
def s1b(spark, sf):
    """The whole snapshot with every fiftieth line cut off near its end, most often inside an edge: error rows, by the id they begin with."""
    lines = spark.read.text(snapshot_path(spark, sf)).select(F.trim("value").alias("value")).where("value <> ''")
    cut_off = F.regexp_extract("value", "[0-9]+", 0).cast("long") % 50 == 0
    path = new_path(spark, "broken")
    lines.select(F.when(cut_off, F.substring("value", F.lit(1), F.length("value") - 3)).otherwise(F.col("value")).alias("value")).write.text(path, compression="gzip")
    return snap.unreadable_lines(spark, path).select(F.regexp_extract("line", "[0-9]+", 0).cast("long").alias("vid"))


@query("s4_snapshot_file_count", graph_sql("""
SELECT node_type, count(*) AS n, 15 * ceil(count(*) / (15 * 1000.0))::BIGINT AS n_files FROM v WHERE node_type IS NOT NULL GROUP BY 1"""))
def s4(spark, sf):
    """Files per node type with 15 threads and 1,000 vertices per file."""
    rows = graph(spark, sf).v.where("node_type IS NOT NULL").groupBy("node_type").agg(F.count("*").alias("n"))
    return rows.withColumn("n_files", snap.file_count_column(F.col("n"), 15, 1000))


OFFSET = 100 * BASE


@query("s5_reload_with_new_ids", graph_sql(f"""
SELECT eid, src + {OFFSET} AS src, dst + {OFFSET} AS dst, label FROM e WHERE src IN (SELECT vid FROM v) AND dst IN (SELECT vid FROM v)"""))
def s5(spark, sf):
    v, e = snap.read_snapshot(spark, snapshot_path(spark, sf), "inv-")
    return snap.reload_with_new_ids(v, e, OFFSET)[1].select("eid", "src", "dst", "label")


@query("s5_reload_errors", graph_sql("""
SELECT eid, src, dst, CASE WHEN src NOT IN (SELECT vid FROM v) THEN 'src' ELSE 'dst' END AS unmapped FROM e
WHERE src NOT IN (SELECT vid FROM v) OR dst NOT IN (SELECT vid FROM v)"""))
def s5b(spark, sf):
    g = graph(spark, sf)
    return snap.reload_with_new_ids(g.v, g.e, OFFSET)[3]


@query("s5_reload_allocated", graph_sql(f"""
SELECT eid, s.n AS src, d.n AS dst FROM e JOIN ids s ON s.vid = src JOIN ids d ON d.vid = dst""", f"""
ids AS MATERIALIZED (SELECT vid, {OFFSET} - 1 + row_number() OVER (ORDER BY (node_type = 'lineitem') IS TRUE, vid) AS n FROM v)"""))
def s5c(spark, sf):
    """A first load lacks the lines, whose edges then exceed the error budget; the second one keeps its ids and goes on."""
    g, store = graph(spark, sf), VersionedStore(spark, new_path(spark, "reload"))
    try:
        id_map.load(store, g.v.where("NOT (node_type <=> 'lineitem')"), g.e, OFFSET, max_errors=0)
    except snap.LoadFailed:
        pass
    now = id_map.load(store, g.v, g.e, OFFSET, max_errors=None)
    return store.read("edges", now).select("eid", "src", "dst")


@query("s6_error_budget", graph_sql("""
SELECT label, count(*) AS n_errors, count(*) <= 25 AS within_budget FROM e
WHERE src NOT IN (SELECT vid FROM v) OR dst NOT IN (SELECT vid FROM v) GROUP BY 1"""))
def s6(spark, sf):
    """Error counts per label next to the verdict of the budget check."""
    g = graph(spark, sf)
    errors = written(snap.reload_with_new_ids(g.v, g.e, OFFSET)[3].join(g.e.select("eid", "label"), "eid"), "errors")
    rows = []
    for label in sorted(r["label"] for r in g.rules.select("label").distinct().collect()):
        mine = errors.where(F.col("label") == label)
        try:
            snap.check_error_budget(mine)
            ok = True
        except snap.LoadFailed:
            ok = False
        rows.append(mine.groupBy("label").agg(F.count("*").alias("n_errors")).withColumn("within_budget", F.lit(ok)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


HIST = f"""
pr AS (
  SELECT vid, node_type, source_of_truth AS sot, unnest(map_entries(props)) AS m FROM v),
hp AS (
  SELECT vid, node_type, sot, m.key AS key, m.value AS value FROM pr
  UNION ALL SELECT vid, node_type, source_of_truth, 'inv-node-type', node_type FROM v WHERE node_type IS NOT NULL
  UNION ALL SELECT vid, node_type, source_of_truth, 'inv-uri', uri FROM v
  UNION ALL SELECT vid, node_type, source_of_truth, 'inv-uuid', uuid FROM v
  UNION ALL SELECT vid, node_type, source_of_truth, 'resource-version', resource_version FROM v
  UNION ALL SELECT vid, node_type, source_of_truth, 'source-of-truth', source_of_truth FROM v
  UNION ALL SELECT vid, node_type, source_of_truth, 'inv-created-ts', created_ts::VARCHAR FROM v WHERE created_ts IS NOT NULL
  UNION ALL SELECT vid, node_type, source_of_truth, 'inv-last-mod-ts', last_mod_ts::VARCHAR FROM v WHERE last_mod_ts IS NOT NULL
  UNION ALL SELECT vid, node_type, source_of_truth, 'end-ts', end_ts::VARCHAR FROM v WHERE end_ts IS NOT NULL
  UNION ALL SELECT vid, node_type, source_of_truth, 'start-ts', '{NOW_MS}' FROM v)"""


@query("s7_load_history_init", graph_sql(f"""
SELECT vid, hp.key, value, {NOW_MS}::BIGINT AS start_ts,
  CASE WHEN hp.key IN ('inv-node-type', 'inv-uri', 'source-of-truth', 'start-ts') OR hp.key = key_prop THEN sot ELSE 'N/A' END AS source_of_truth
FROM hp LEFT JOIN nt ON nt.node_type = hp.node_type""", HIST))
def s7(spark, sf):
    g = graph(spark, sf)
    return snap.load_history_init(g.v, g.e, g.nt, NOW_MS, "inv-")[0].drop("end_ts")


@query("s7_load_history_init_edges", graph_sql(
    f"SELECT eid, {NOW_MS}::BIGINT AS start_ts, 'N/A' AS source_of_truth FROM e"))
def s7b(spark, sf):
    g = graph(spark, sf)
    return snap.load_history_init(g.v, g.e, g.nt, NOW_MS, "inv-")[1].select("eid", "start_ts", "source_of_truth")


@query("s8_filter_snapshot_types", graph_sql("SELECT vid, node_type FROM v WHERE node_type IN ('customer', 'supplier', 'part')"))
def s8(spark, sf):
    v, _ = snap.read_snapshot(spark, snapshot_path(spark, sf), "inv-")
    return snap.filter_snapshot_types(v, ["customer", "supplier", "part"]).select("vid", "node_type")


# ---------------------------------------------------------------- feeds and models

FEED_HEADER = "order, customer, status, priority"


def feed_lines(spark, sf) -> DataFrame:
    """Orders as CSV text: cancelled-looking rows lose a field, some priorities are blank, headers are repeated."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey").cast("string")
    full = F.concat_ws(",", F.concat(F.lit(' "'), k, F.lit('"')), F.col("o_custkey").cast("string"), "o_orderstatus",
                       F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")))
    short = F.concat_ws(",", k, "o_orderstatus")
    return o.select(F.when(F.col("o_orderstatus") == "P", short).otherwise(full).alias("value")).unionByName(
        o.groupBy("o_orderpriority").agg(F.lit(FEED_HEADER).alias("value")).select("value"))


def feed(spark, sf):
    path = new_path(spark, "feed")
    feed_lines(spark, sf).write.text(path)
    return feeds.read_feed(spark, path, {"order": 0, "status": 2, "priority": 3}, 4, FEED_HEADER)


@query("s9_read_feed", """
SELECT o_orderkey::VARCHAR AS "order", o_orderstatus AS status, o_orderpriority AS priority FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def s9(spark, sf):
    return feed(spark, sf)[0]


@query("s9_read_feed_fallout", """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'width' ELSE 'empty field' END AS reason, count(*) AS n FROM orders
WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW' GROUP BY 1""")
def s9b(spark, sf):
    return feed(spark, sf)[1].groupBy("reason").agg(F.count("*").alias("n"))


def root_models(spark, sf):
    """Every part is a model definition; parts of size 1 to 10 are models already, of size 1 to 5 with a version."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    name = F.concat(F.lit("part"), F.col("p_partkey").cast("string"))
    inv, ver = F.concat(F.lit("inv-"), name), F.concat(F.lit("ver-"), name)
    line = lambda kind, value: F.concat(F.lit(f"INV.{kind}."), name, F.lit(" = "), value)
    lines = part.select(F.explode(F.array(
        line("model-invariant-id", inv), line("model-version-id", ver),
        F.when(F.col("p_size") > 25, line("model-type", F.lit("resource"))), F.concat(F.lit("# "), name),
        F.concat(F.lit("bad."), name, F.lit("=x")))).alias("value")).where("value IS NOT NULL")
    g = graph(spark, sf)

    def old(vid, kind, p, value, cond):
        return part.where(cond).select((F.col("p_partkey") + vid).alias("vid"), F.lit(kind).alias("node_type"),
                                       F.create_map(F.lit(p), value).alias("props"))

    v = g.v.select("vid", "node_type", "props").unionByName(
        old(21 * BASE, "model", "model-invariant-id", inv, F.col("p_size") <= 10)).unionByName(
        old(22 * BASE, "model-ver", "model-version-id", ver, F.col("p_size") <= 5))
    e = g.e.select("src", "dst", "label").unionByName(part.where("p_size <= 3").select(
        (F.col("p_partkey") + 21 * BASE).alias("src"), (F.col("p_partkey") + 22 * BASE).alias("dst"),
        F.lit("model-vers").alias("label")))
    return feeds.load_root_models(feeds.parse_properties(lines), v, e, BASE, 30 * BASE, NOW_MS)


@query("s10_load_root_models", """
SELECT 'model' AS node_type, '/service-design-and-creation/models/model/inv-part'||p_partkey AS uri,
  CASE WHEN p_size > 25 THEN 'resource' ELSE 'widget' END AS model_type, 'part'||p_partkey AS model_name FROM part WHERE p_size > 10
UNION ALL SELECT 'model-ver', '/service-design-and-creation/models/model/inv-part'||p_partkey||'/model-vers/model-ver/ver-part'||p_partkey,
  NULL, 'part'||p_partkey FROM part WHERE p_size > 5""")
def s10(spark, sf):
    return root_models(spark, sf)[0].select("node_type", "uri", prop("model-type").alias("model_type"),
                                            prop("model-name").alias("model_name"))


@query("s10_load_root_models_edges", """
SELECT 'models' AS label, count(*) AS n FROM part UNION ALL SELECT 'model-vers', count(*) FROM part WHERE p_size > 3""")
def s10b(spark, sf):
    return root_models(spark, sf)[1].groupBy("label").agg(F.count("*").alias("n"))


@query("s11_write_events", graph_sql(
    f"SELECT '{NOW_MS}_'||vid||'_'||resource_version AS value FROM v"))
def s11(spark, sf):
    path = feeds.write_events(graph(spark, sf).v, new_path(spark, "events"), F.lit(NOW_MS))
    return spark.read.text(path)


@query("s11_write_deletes", graph_sql("""
SELECT coalesce(node_type, '')||'#@#'||uri||'#@#{'||array_to_string(list_transform(map_entries(props),
  lambda x: '"'||x.key||'":"'||x.value||'"'), ',')||'}' AS value FROM v"""))
def s11b(spark, sf):
    path = feeds.write_deletes(graph(spark, sf).v, new_path(spark, "deletes"))
    return spark.read.text(path)


# ---------------------------------------------------------------- payloads and events


@query("p1_payload_roots", t_sql("SELECT DISTINCT ov AS vid FROM co WHERE regexp_full_match(cp['market-segment'], 'B.*|M.*')"))
def p1(spark, sf):
    return payload.payload_roots(graph(spark, sf), "customer", {"market-segment": "B.*|M.*"}, "order")


@query("p1_payload_roots_cousin", t_sql("""
SELECT DISTINCT lv AS vid FROM lp JOIN p ON p.vid = pv WHERE regexp_full_match(props['brand'], 'Brand#[12]')"""))
def p1b(spark, sf):
    return payload.payload_roots(graph(spark, sf), "part", {"brand": "Brand#[12]"}, "lineitem")


OWN = """array_to_string(list_transform(list_sort(map_entries(props)), lambda x: '"'||x.key||'":"'||x.value||'"'), ',')"""
FULL = OWN.replace("map_entries(props)", "map_entries(map_concat(props, MAP {'resource-version': resource_version}))")
DOCS = f"""
down AS MATERIALIZED (SELECT DISTINCT parent_vid, child_vid, node_type AS child_type FROM tree JOIN v ON vid = child_vid),
occ AS (
  SELECT vid AS doc_vid, vid, '' AS up, '' AS path, '' AS child_type FROM v WHERE node_type = 'customer'
  UNION ALL SELECT doc_vid, child_vid, path, path||'/'||d.child_type||chr(1)||lpad(child_vid::VARCHAR, 20, '0'), d.child_type
  FROM occ JOIN down d ON parent_vid = vid),
far AS MATERIALIZED (SELECT vid AS o, '{{"related-to":"'||node_type||'","related-link":"'||uri||'"}}' AS link, node_type FROM v
  WHERE node_type IN ('nation', 'part', 'supplier', 'customer')),
lnk AS MATERIALIZED (
  SELECT src AS vid, link FROM e JOIN far ON dst = o WHERE contains_other_v = 'NONE' AND node_type <> 'customer'
  UNION SELECT dst, link FROM e JOIN far ON src = o WHERE contains_other_v = 'NONE' AND node_type <> 'customer'
  UNION SELECT child_vid, link FROM tree JOIN far ON parent_vid = o WHERE node_type = 'customer'),
ends AS (SELECT vid, min(link) AS low, max(link) AS high FROM lnk GROUP BY 1),
spot AS MATERIALIZED (
  SELECT occ.*, CASE WHEN path = '' THEN {OWN} ELSE {FULL} END AS own, low, high,
    row_number() OVER (PARTITION BY doc_vid, up ORDER BY child_type, occ.vid) AS nth,
    row_number() OVER (PARTITION BY doc_vid, up, child_type ORDER BY occ.vid) AS of_type,
    row_number() OVER (PARTITION BY doc_vid, up, child_type ORDER BY occ.vid DESC) AS to_end
  FROM occ JOIN v USING (vid) LEFT JOIN ends USING (vid)),
pieces AS (
  SELECT doc_vid, path||' ' AS path, CASE WHEN path = '' THEN '' WHEN of_type > 1 THEN ','
      ELSE ',"'||child_type||'":[' END||'{{'||own AS text FROM spot
  UNION ALL SELECT doc_vid, path||'~', '}}'||CASE WHEN path <> '' AND to_end = 1 THEN ']' ELSE '' END FROM spot
  UNION ALL SELECT doc_vid, path||'!'||link, CASE WHEN link = low THEN ',"relationship-list":{{"relationship":[' ELSE ',' END||
    link||CASE WHEN link = high THEN ']}}' ELSE '' END FROM spot JOIN lnk USING (vid))"""


@query("p2_build_payload", graph_sql("SELECT doc_vid, path, text FROM pieces", DOCS, recursive=True))
def p2(spark, sf):
    g = graph(spark, sf)
    return payload.build_payload(g.v, g.e, only_type(g.v, "customer"), ["nation", "part", "supplier"], ["customer"])


@query("p2_documents", graph_sql("""
SELECT uri, md5('{"uri":"'||uri||'","payload":'||string_agg(text, ' ' ORDER BY path)||'}') AS document, true AS parses
FROM pieces JOIN v ON v.vid = doc_vid GROUP BY doc_vid, uri""", DOCS, recursive=True))
def p2b(spark, sf):
    """The written documents, one per line, as a reader of lines finds them."""
    v = graph(spark, sf).v
    n_files = snap.snapshot_file_count(v.count(), 8)
    path = payload.write_documents(p2(spark, sf), only_type(v, "customer"), new_path(spark, "documents"), n_files, "gzip")
    lines = spark.read.text(path).select(F.btrim("value").alias("value")).where("value <> ''")
    return lines.select(
        F.get_json_object("value", "$.uri").alias("uri"), F.md5(F.col("value").cast("binary")).alias("document"),
        F.try_parse_json("value").isNotNull().alias("parses"))


EVENTS = f"""
own AS MATERIALIZED (SELECT vid, node_type, uri, {OWN} AS own FROM v),
up AS MATERIALIZED (SELECT child_vid AS vid, min(parent_vid) AS p FROM tree GROUP BY 1),
up1 AS (SELECT up.vid, p FROM up JOIN v ON v.vid = p),
up2 AS (SELECT a.vid, b.p FROM up a JOIN up b ON b.vid = a.p)"""


@query("p3_build_events", graph_sql("""
SELECT l.vid, coalesce(c.node_type, o.node_type) AS top_type,
  '{"event-header":{"entity-link":"http://host/v11'||l.uri||'","action":"CREATE","entity-type":"lineitem","top-entity-type":"'||
  coalesce(c.node_type, o.node_type)||'","source-name":"ERP","version":"v11","id":"TXID","event-type":"BASELINE","domain":"UNK","sequence-number":"UNK","severity":"UNK"},"entity":'||
  CASE WHEN c.vid IS NULL THEN '{'||o.own||',"lineitem":[{'||l.own||'}]}'
    ELSE '{'||c.own||',"order":[{'||o.own||',"lineitem":[{'||l.own||'}]}]}' END||'}' AS event
FROM own l JOIN up1 USING (vid) JOIN own o ON o.vid = up1.p LEFT JOIN up2 ON up2.vid = l.vid LEFT JOIN own c ON c.vid = up2.p
WHERE l.node_type = 'lineitem'""", EVENTS))
def p3(spark, sf):
    g = graph(spark, sf)
    return payload.build_events(g.v, g.e, only_type(g.v, "lineitem"), "http://host/", "v11", "ERP")


CHANGES = """
chg AS (SELECT event_id AS ts, (3*10**15)::BIGINT + user_id AS vid,
  (user_id * 10 + CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)::VARCHAR AS version FROM events),
lastc AS (SELECT vid, min(ts) AS ts, max_by(version, ts) AS version FROM chg GROUP BY 1),
hit AS (SELECT l.vid, uri, version, row_number() OVER (ORDER BY ts, l.vid) AS rn FROM lastc l
  JOIN v ON v.vid = l.vid AND v.resource_version = version WHERE node_type = 'customer')"""


def change_lines(spark, sf) -> DataFrame:
    """Each event records a customer version; errors record an outdated one."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    version = F.col("user_id") * 10 + F.when(F.col("event_type") == "error", 0).otherwise(1)
    return ev.select(F.concat_ws("_", F.col("event_id").cast("string"),
                                 (F.col("user_id") + CODES["customer"] * BASE).cast("string"),
                                 version.cast("string")).alias("value"))


@query("p4_notify_changes", graph_sql("SELECT vid, uri, version, ((rn - 1) // 20)::BIGINT AS batch FROM hit", CHANGES))
def p4(spark, sf):
    events = payload.parse_event_lines(change_lines(spark, sf))
    return payload.notify_changes(events, graph(spark, sf).v, ["customer"], 20)


@query("p5_notify_deletes", graph_sql("""
SELECT node_type, uri, '{"brand":"'||props['brand']||'"}' AS body FROM v WHERE node_type = 'part'
UNION ALL SELECT node_type, uri, '{"name":"'||props['name']||'"}' FROM v WHERE node_type = 'region'"""))
def p5(spark, sf):
    """Nation lines carry a fourth part and are no delete rows."""
    v = graph(spark, sf).v
    body = lambda p: F.concat(F.lit(f'{{"{p}":"'), prop(p), F.lit('"}'))
    text = F.when(F.col("node_type") == "part", body("brand")).when(F.col("node_type") == "region", body("name")).when(
        F.col("node_type") == "nation", F.concat_ws("#@#", prop("name"), F.lit("extra")))
    lines = v.where(F.col("node_type").isin("part", "region", "nation")).select(
        F.concat_ws("#@#", "node_type", "uri", text).alias("value"))
    return payload.notify_deletes(lines)


RESEND = """
ev AS (SELECT event_id, '/inventory/v11/customers/customer/'||user_id AS entity_link,
  CASE event_type WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action,
  CASE WHEN event_type = 'click' THEN NULL WHEN value > 5 THEN (user_id * 10 + 1)::VARCHAR ELSE (user_id * 10)::VARCHAR END AS ver FROM events)"""


@query("p6_resend_filter", graph_sql("""
SELECT event_id, entity_link, action FROM ev WHERE ver IS NOT NULL AND (
  (SELECT count(*) FROM v WHERE uri = substr(entity_link, 15) AND resource_version = ver) = 1
  OR (action = 'DELETE' AND NOT EXISTS (SELECT 1 FROM v WHERE uri = substr(entity_link, 15))))""", RESEND))
def p6(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    uid = F.col("user_id")
    top = (uid * 10 + F.when(F.col("value") > 5, 1).otherwise(0)).cast("string")
    events = ev.select(
        "event_id", F.concat(F.lit("/inventory/v11/customers/customer/"), uid.cast("string")).alias("entity_link"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("action"),
        F.when(F.col("event_type") == "click", F.array().cast("array<string>")).otherwise(
            F.array(F.lit("0"), top)).alias("versions"))
    return payload.resend_filter(events, graph(spark, sf).v).select("event_id", "entity_link", "action")


@query("p7_extract_events", """
SELECT event_id::VARCHAR AS event FROM events WHERE event_type = 'click' AND value <= 5""")
def p7(spark, sf):
    """Events as log lines of 29 fields, the type in the fifth; large values are return lines."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    fields = [F.lit(f"f{i}") for i in range(29)]
    fields[4] = F.col("event_type")
    fields[6] = F.when(F.col("value") > 5, "InvokeReturn").otherwise("Invoke")
    fields[28] = F.col("event_id").cast("string")
    return payload.extract_events(ev.select(F.concat_ws("|", *fields).alias("value")), "click")


def snapshot_files(spark, sf) -> DataFrame:
    """Each event is one part file of the snapshot of its minute."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    name = F.concat(F.lit("/snapshots/dataSnapshot.graphSON."), F.date_format(ts, "yyyyMMddHHmm"), F.lit(".P"),
                    F.col("user_id").cast("string"))
    return ev.select(name.alias("name"), F.unix_millis(ts).alias("modified"))


FILES = """WITH files AS (SELECT '/snapshots/dataSnapshot.graphSON.'||strftime(ts, '%Y%m%d%H%M') AS prefix,
  '/snapshots/dataSnapshot.graphSON.'||strftime(ts, '%Y%m%d%H%M')||'.P'||user_id AS name, epoch_ms(ts) AS modified FROM events)"""


@query("p8_pick_snapshot", f"{FILES} SELECT name FROM files ORDER BY modified DESC, name DESC LIMIT 1 OFFSET 1")
def p8(spark, sf):
    return payload.pick_snapshot(snapshot_files(spark, sf))


@query("p8_pick_snapshot_set", f"{FILES} SELECT DISTINCT prefix AS name FROM files ORDER BY 1 DESC LIMIT 1 OFFSET 1")
def p8b(spark, sf):
    return payload.pick_snapshot_set(snapshot_files(spark, sf))
