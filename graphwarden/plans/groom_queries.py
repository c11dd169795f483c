"""Registered queries for grooming, duplicates and repair, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.keys import prop
from graphwarden.model import Graph
from graphwarden.operators import dupes, groom, repair
from graphwarden.operators.structure import bucketed_parents
from graphwarden.plans.oracle import CHECKS_CTES, graph_sql
from graphwarden.plans.registry import Registry
from graphwarden.plans.structure_queries import MONTHS_6, NOW_MS, START
from graphwarden.sources.tables import BASE, bucketed_graph, graph

query = Registry()

# ---------------------------------------------------------------- SQL parts

BAD_EDGE_CTES = """
ends AS (
  SELECT eid, 'src' AS side, src AS vid FROM e UNION ALL SELECT eid, 'dst', dst FROM e),
state AS (
  SELECT v.vid, CASE WHEN coalesce(v.node_type, '') = '' THEN 'untyped'
    WHEN nt.node_type IS NOT NULL AND (coalesce(props[key_prop], '') = '' OR coalesce(uri, '') = '')
      THEN 'missing_keys' ELSE 'ok' END AS state
  FROM v LEFT JOIN nt ON nt.node_type = v.node_type),
reach AS (
  SELECT DISTINCT eid FROM ends JOIN chk USING (vid)
  WHERE NOT (key_bad AND NOT uri_ok) AND (last_mod_ts IS NULL OR last_mod_ts >= {start})),
bad AS MATERIALIZED (
  SELECT ends.eid, ends.vid AS bad_vid, side, coalesce(state, 'absent') AS reason
  FROM ends JOIN reach USING (eid) LEFT JOIN state USING (vid) WHERE coalesce(state, 'absent') <> 'ok')
"""
# The keeper fold as a true member-by-member fold.
DUPE_CTES = """
mem0 AS (
  SELECT v.vid, v.node_type, uri, props[key_prop] AS key_str, -1::BIGINT AS parent_vid
  FROM v JOIN nt USING (node_type) WHERE parent_type IS NULL AND coalesce(props[key_prop], '') <> ''
  UNION ALL
  SELECT DISTINCT v.vid, v.node_type, v.uri, v.props[key_prop], t.parent_vid
  FROM v JOIN nt USING (node_type) JOIN tree t ON t.child_vid = v.vid
  JOIN v p ON p.vid = t.parent_vid AND p.node_type = parent_type
  WHERE coalesce(v.props[key_prop], '') <> ''),
mem AS MATERIALIZED (
  SELECT *, min(vid) OVER g AS group_id, count(*) OVER g AS n_members,
    row_number() OVER (PARTITION BY node_type, key_str, parent_vid ORDER BY vid) AS pos,
    min(uri) OVER g = max(uri) OVER g AND min(uri) OVER g <> '' AS one_uri
  FROM mem0 WINDOW g AS (PARTITION BY node_type, key_str, parent_vid)
  QUALIFY count(*) OVER g > 1),
nbl AS (
  SELECT vid, list(other_vid) AS l, list(DISTINCT other_vid) AS s FROM nb
  WHERE vid IN (SELECT vid FROM mem) GROUP BY 1),
downer AS (SELECT min(vid) AS vid FROM v WHERE uri <> '' GROUP BY uri),
fact AS MATERIALIZED (
  SELECT mem.*, coalesce(l, []) AS l, coalesce(s, []) AS s, downer.vid IS NOT NULL AS ok
  FROM mem LEFT JOIN nbl USING (vid) LEFT JOIN downer USING (vid)),
fold(group_id, parent_vid, pos, cur) AS (
  SELECT group_id, parent_vid, 1::BIGINT, vid FROM fact WHERE pos = 1 AND one_uri
  UNION ALL
  SELECT f.group_id, f.parent_vid, b.pos,
    CASE WHEN len(a.l) = len(b.l) THEN
           CASE WHEN len(list_intersect(a.s, b.s)) = len(a.s)
                THEN CASE WHEN a.ok THEN a.vid WHEN b.ok THEN b.vid END END
         WHEN len(a.l) > len(b.l) THEN CASE WHEN len(list_intersect(a.s, b.s)) = len(b.s) THEN a.vid END
         ELSE CASE WHEN len(list_intersect(a.s, b.s)) = len(a.s) THEN b.vid END END
  FROM fold f JOIN fact a ON a.group_id = f.group_id AND a.parent_vid = f.parent_vid AND a.vid = f.cur
  JOIN fact b ON b.group_id = f.group_id AND b.parent_vid = f.parent_vid AND b.pos = f.pos + 1),
keep AS MATERIALIZED (
  SELECT m.group_id, m.parent_vid, m.n_members, CASE WHEN k.ok THEN fold.cur END AS keeper_vid
  FROM (SELECT DISTINCT group_id, parent_vid, n_members FROM mem) m
  LEFT JOIN fold ON fold.group_id = m.group_id AND fold.parent_vid = m.parent_vid AND fold.pos = m.n_members
  LEFT JOIN fact k ON k.group_id = m.group_id AND k.parent_vid = m.parent_vid AND k.vid = fold.cur)
"""


def chk(body: str, *ctes: str) -> str:
    return graph_sql(body, CHECKS_CTES, *ctes)


def bad_edge_sql(start: int = 0) -> str:
    return BAD_EDGE_CTES.format(start=start)


def dupe_sql(body: str, *ctes: str) -> str:
    return graph_sql(body, DUPE_CTES, *ctes, recursive=True)


CANDIDATES_CTE = """
cand AS MATERIALIZED (
  SELECT 'Phantom' AS kind, vid::VARCHAR AS id FROM chk WHERE key_bad AND NOT uri_ok {w}
  UNION ALL SELECT 'Missing Type', vid::VARCHAR FROM v WHERE node_type IS NULL
  UNION ALL SELECT 'Orphan', vid::VARCHAR FROM chk WHERE parent_type IS NOT NULL AND n_parents = 0 {w}
  UNION ALL SELECT DISTINCT 'Bad Edge', eid FROM bad
  UNION ALL SELECT DISTINCT 'Duplicate', mem.vid::VARCHAR FROM mem JOIN keep USING (group_id, parent_vid)
    WHERE keeper_vid IS NOT NULL AND mem.vid <> keeper_vid)
"""


def cand_sql(body: str, *ctes: str, window: str = "", start: int = 0) -> str:
    return graph_sql(body, CHECKS_CTES, bad_edge_sql(start), DUPE_CTES,
                     CANDIDATES_CTE.format(w=window), *ctes, recursive=True)


# ---------------------------------------------------------------- shared frames

_passes: dict[tuple, groom.Findings] = {}


def found(spark, sf, minutes: int = 0) -> groom.Findings:
    """One grooming pass per session, table folder and window."""
    key = (spark.sparkContext.applicationId, sf, minutes)
    if key not in _passes:
        g = graph(spark, sf)
        _passes[key] = groom.groom(g.v, g.e, g.nt, NOW_MS, minutes)
    return _passes[key]


def candidates(spark, sf, minutes: int = 0) -> DataFrame:
    return groom.delete_candidates(found(spark, sf, minutes))


def on_graph(fn):
    """A query whose operator takes (v, e, nt)."""
    def run(spark, sf):
        g = graph(spark, sf)
        return fn(g.v, g.e, g.nt)
    return run


# ---------------------------------------------------------------- detection

query("g1_orphans", chk("SELECT vid, node_type FROM chk WHERE parent_type IS NOT NULL AND n_parents = 0"))(
    on_graph(groom.find_orphans))
query("g2_missing_type", graph_sql("SELECT vid FROM v WHERE node_type IS NULL"))(on_graph(groom.find_missing_type))
query("g3_bad_uri", chk("SELECT vid, node_type, uri FROM chk WHERE NOT key_bad AND NOT uri_ok"))(
    on_graph(groom.find_bad_uri))
query("g4_bad_key", chk("SELECT vid, node_type FROM chk WHERE key_bad AND uri_ok"))(on_graph(groom.find_bad_key))
query("g5_ghosts", chk("SELECT vid, node_type FROM chk WHERE key_bad AND NOT uri_ok"))(on_graph(groom.find_ghosts))
query("g6_bad_edges", chk("SELECT eid, bad_vid, side, reason FROM bad", bad_edge_sql()))(
    on_graph(groom.find_bad_edges))


@query("g6_bad_edges_bucketed", query.sql["g6_bad_edges"])
def g6b(spark, sf):
    b = bucketed_graph(spark, sf)
    checks = groom.vertex_checks(b.v, None, b.nt, counts=bucketed_parents(b).select("vid", "n_parents"))
    return groom.bad_edges_from(b.v, b.out, b.nt, checks)


query("g6_bad_edges_in_window", chk("SELECT eid, bad_vid, side, reason FROM bad", bad_edge_sql(START)))(
    on_graph(lambda v, e, nt: groom.find_bad_edges(v, e, nt, NOW_MS, MONTHS_6)))
query("g7_dangling_ends", graph_sql("""
SELECT eid, 'src' AS side, src AS bad_vid FROM e WHERE src NOT IN (SELECT vid FROM v)
UNION ALL SELECT eid, 'dst', dst FROM e WHERE dst NOT IN (SELECT vid FROM v)"""))(
    on_graph(lambda v, e, nt: groom.find_dangling_ends(v, e)))
query("g8_multi_parent", chk(
    "SELECT vid, node_type, n_parents FROM chk WHERE parent_type IS NOT NULL AND n_parents > 1"))(
    on_graph(groom.find_multi_parent))

MEMBERS = "SELECT group_id, parent_vid, node_type, key_str, vid, n_members FROM mem"
query("g9_dupe_groups_top", dupe_sql(f"{MEMBERS} WHERE parent_vid = -1"))(
    on_graph(lambda v, e, nt: dupes.find_dupe_groups_top(v, nt)))
query("g10_dupe_groups_dep", dupe_sql(f"{MEMBERS} WHERE parent_vid <> -1"))(on_graph(dupes.find_dupe_groups_dep))


@query("g11_pick_of_two", dupe_sql("""
SELECT a.vid AS a, b.vid AS b,
  CASE WHEN len(a.l) = len(b.l) THEN CASE WHEN len(list_intersect(a.s, b.s)) = len(a.s)
         THEN CASE WHEN a.ok THEN a.vid WHEN b.ok THEN b.vid END END
       WHEN len(a.l) > len(b.l) THEN CASE WHEN len(list_intersect(a.s, b.s)) = len(b.s) THEN a.vid END
       WHEN len(list_intersect(a.s, b.s)) = len(a.s) THEN b.vid END AS keeper_vid
FROM fact a JOIN fact b USING (group_id, parent_vid) WHERE a.pos = 1 AND b.pos > 1"""))
def g11(spark, sf):
    g = graph(spark, sf)
    groups = found(spark, sf).dupes
    pairs = groups.where(F.col("vid") != F.col("group_id")).select(
        F.col("group_id").alias("a"), F.col("vid").alias("b"))
    return dupes.pick_of_two(pairs, g.v, g.e, g.nt)


@query("g12_choose_keeper", dupe_sql("SELECT group_id, parent_vid, n_members, keeper_vid FROM keep"))
def g12(spark, sf):
    g = graph(spark, sf)
    return dupes.choose_keeper(dupes.find_dupe_groups(g.v, g.e, g.nt), g.v, g.e, g.nt)


@query("g13_drop_found", dupe_sql("""
SELECT v.vid, count(*) OVER (PARTITION BY v.node_type, props[key_prop]) AS n_same_key
FROM v JOIN nt USING (node_type) WHERE vid NOT IN (SELECT vid FROM mem) AND props[key_prop] IS NOT NULL"""))
def g13(spark, sf):
    g = graph(spark, sf)
    keyed = dupes._keyed(g.v, g.nt)
    left = dupes.drop_found(keyed, dupes.find_dupe_groups(g.v, g.e, g.nt))
    sizes = left.groupBy("node_type", "key_str").agg(F.count("*").alias("n_same_key"))
    return left.join(sizes, ["node_type", "key_str"]).select("vid", "n_same_key")


def tenant_graph(spark, sf) -> Graph:
    """Orders as tenants of customers (keyed by priority), linked by status to a server or a subscription."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    c = F.col
    tid = c("o_orderkey") + 12 * BASE
    rid = c("o_custkey") + 11 * BASE
    far = F.when(c("o_orderstatus") == "F", c("o_orderkey") + 13 * BASE).when(
        c("o_orderstatus") == "O", c("o_orderkey") + 14 * BASE)
    null = F.lit(None).cast("long")

    def vertices(df, vid, kind, uri, props):
        return df.select(
            vid.alias("vid"), kind.alias("node_type"), uri.alias("uri"), F.lit(None).cast("string").alias("uuid"),
            F.lit("1").alias("resource_version"), null.alias("created_ts"), null.alias("last_mod_ts"),
            null.alias("end_ts"), F.lit("x").alias("source_of_truth"), props.alias("props"))

    region_uri = F.concat(F.lit("/cloud-regions/"), c("o_custkey").cast("string"))
    linked = orders.where(far.isNotNull())
    kind = F.when(c("o_orderstatus") == "F", "vserver").otherwise("service-subscription")
    v = vertices(orders.select("o_custkey").distinct(), rid, F.lit("cloud-region"), region_uri,
                 F.create_map(F.lit("region-id"), c("o_custkey").cast("string")))
    v = v.unionByName(vertices(
        orders, tid, F.lit("tenant"), F.concat(region_uri, F.lit("/tenants/"), c("o_orderpriority")),
        F.create_map(F.lit("tenant-id"), c("o_orderpriority"))))
    v = v.unionByName(vertices(linked, far, kind, far.cast("string"),
                               F.create_map(F.lit("id"), far.cast("string"))))

    def edge(df, src, dst, contains):
        return df.select(F.concat_ws(":", src.cast("string"), dst.cast("string")).alias("eid"), src.alias("src"),
                         dst.alias("dst"), F.lit("l").alias("label"), F.lit(contains).alias("contains_other_v"))

    e = edge(orders, tid, rid, "IN").unionByName(edge(linked, tid, far, "NONE"))
    nt = spark.createDataFrame(
        [("cloud-region", ["region-id"], []), ("tenant", ["tenant-id"], ["cloud-region"]),
         ("vserver", ["id"], []), ("service-subscription", ["id"], [])],
        "node_type string, keys array<string>, dependent_on array<string>")
    return Graph(v, e, nt, None)


TENANT_SQL = """
WITH RECURSIVE t AS (
  SELECT o_orderkey + (12*10**15)::BIGINT AS vid, o_custkey + (11*10**15)::BIGINT AS parent_vid, o_orderpriority AS k,
    o_orderstatus AS st FROM orders),
m AS MATERIALIZED (
  SELECT *, min(vid) OVER w AS group_id, row_number() OVER (PARTITION BY parent_vid, k ORDER BY vid) AS pos,
    count(*) OVER w AS n_members FROM t WINDOW w AS (PARTITION BY parent_vid, k)
  QUALIFY count(*) OVER w > 1),
fold AS (
  SELECT group_id, parent_vid, pos, vid AS cur, st FROM m WHERE pos = 1
  UNION ALL
  SELECT f.group_id, f.parent_vid, b.pos,
    CASE WHEN f.st = 'P' AND b.st = 'P' THEN CASE WHEN f.cur = f.group_id THEN f.cur END
         WHEN f.st <> 'P' AND b.st = 'P' THEN f.cur WHEN f.st = 'P' AND b.st <> 'P' THEN b.vid
         WHEN f.st = 'F' AND b.st = 'O' THEN b.vid WHEN f.st = 'O' AND b.st = 'F' THEN f.cur END,
    CASE WHEN f.st = 'P' THEN b.st WHEN f.st = 'F' AND b.st = 'O' THEN 'O' ELSE f.st END
  FROM fold f JOIN m b ON b.group_id = f.group_id AND b.pos = f.pos + 1 WHERE f.cur IS NOT NULL)
SELECT m.group_id, m.parent_vid, n_members, CASE WHEN cur = m.group_id THEN cur END AS keeper_vid
FROM m LEFT JOIN fold ON fold.group_id = m.group_id AND fold.pos = n_members WHERE m.pos = 1"""


@query("g14_special_tenant_rule", TENANT_SQL)
def g14(spark, sf):
    g = tenant_graph(spark, sf)
    groups = dupes.find_dupe_groups_dep(g.v, g.e, g.nt)
    return dupes.choose_keeper(groups, g.v, g.e, g.nt, dupes.SpecialRule())


SUMMARY_BODY = """
SELECT (SELECT count(*) FROM chk WHERE true {w}) AS nodes_seen,
  (SELECT count(*) FROM chk WHERE key_bad AND NOT uri_ok {w}) AS ghosts,
  (SELECT count(*) FROM chk WHERE parent_type IS NOT NULL AND n_parents = 0 {w}) AS orphans,
  (SELECT count(*) FROM chk WHERE NOT key_bad AND NOT uri_ok {w}) AS bad_uris,
  (SELECT count(*) FROM chk WHERE key_bad AND uri_ok {w}) AS bad_keys,
  (SELECT count(*) FROM chk WHERE parent_type IS NOT NULL AND n_parents > 1 {w}) AS multi_parents,
  (SELECT count(*) FROM v WHERE node_type IS NULL) AS missing_types,
  (SELECT count(DISTINCT eid) FROM bad) AS bad_edges,
  (SELECT count(*) FROM keep) AS dupe_groups,
  (SELECT count(keeper_vid) FROM keep) AS dupe_groups_with_keeper, '{run}' AS run_type"""
IN_WINDOW = f"AND (last_mod_ts IS NULL OR last_mod_ts >= {START})"


def summary_body(run: str, window: str = "") -> str:
    return SUMMARY_BODY.format(w=window, run=run)


@query("g15_groom_summary", cand_sql(summary_body("FULL")))
def g15(spark, sf):
    return groom.groom_summary(found(spark, sf))


@query("g15_groom_summary_in_window", cand_sql(summary_body("PARTIAL", IN_WINDOW), start=START))
def g15b(spark, sf):
    return groom.groom_summary(found(spark, sf, MONTHS_6))


@query("g16_delete_candidates", cand_sql("SELECT kind, id FROM cand"))
def g16(spark, sf):
    return candidates(spark, sf)


VERTEX_FINDINGS = """
fnd AS (SELECT kind, id::BIGINT AS vid FROM cand WHERE kind <> 'Bad Edge')"""


def vertex_findings(spark, sf):
    return candidates(spark, sf).where(F.col("kind") != groom.BAD_EDGE).select(
        "kind", F.col("id").cast("long").alias("vid"))


@query("g17_groom_detail_props", cand_sql("""
SELECT kind, vid, node_type, uri, m.key AS key, m.value AS value
FROM fnd JOIN v USING (vid), unnest(map_entries(props)) x(m)""", VERTEX_FINDINGS))
def g17(spark, sf):
    g = graph(spark, sf)
    return groom.groom_detail(vertex_findings(spark, sf), g.v, g.e)[0]


@query("g17_groom_detail_edges", cand_sql("""
SELECT kind, fnd.vid, n.dir, n.label, n.other_vid, o.node_type AS other_type, o.vid IS NOT NULL AS other_found
FROM fnd JOIN (SELECT src AS vid, 'OUT' AS dir, label, dst AS other_vid FROM e
  UNION ALL SELECT dst, 'IN', label, src FROM e) n USING (vid) LEFT JOIN v o ON o.vid = n.other_vid""",
                                          VERTEX_FINDINGS))
def g17b(spark, sf):
    g = graph(spark, sf)
    edges = groom.groom_detail(vertex_findings(spark, sf), g.v, g.e)[1]
    return edges.select("kind", "vid", "dir", "label", "other_vid", "other_type", "other_found")


RUNS_SQL = """
WITH runs AS (SELECT epoch_ms(date_trunc('day', ts)) AS run_ts,
  CASE WHEN event_type IN ('error', 'click') THEN 'FULL' ELSE 'PARTIAL' END AS run_type,
  count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2)
SELECT * FROM runs WHERE run_ts = (SELECT max(run_ts) FROM runs)
  AND (run_type = 'FULL' OR NOT EXISTS (SELECT 1 FROM runs WHERE run_type = 'FULL' AND run_ts = (SELECT max(run_ts) FROM runs)))"""


@query("g18_latest_summary", RUNS_SQL)
def g18(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    day = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
    kind = F.when(F.col("event_type").isin("error", "click"), "FULL").otherwise("PARTIAL")
    runs = ev.groupBy(day.alias("run_ts"), kind.alias("run_type")).agg(
        F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"))
    return groom.latest_summary(runs)


# ---------------------------------------------------------------- repair

@query("r1_select_candidates", cand_sql("SELECT kind, id FROM cand WHERE kind NOT IN ('Orphan', 'Duplicate')"))
def r1(spark, sf):
    return repair.select_candidates(candidates(spark, sf), skip_orphans=True, fix_dupes=False)


@query("r1_select_edges_only", cand_sql("SELECT kind, id FROM cand WHERE kind = 'Bad Edge'"))
def r1b(spark, sf):
    return repair.select_candidates(candidates(spark, sf), edges_only=True)


@query("r2_apply_cap", cand_sql(
    "SELECT kind, id FROM cand QUALIFY count(*) OVER (PARTITION BY kind) <= 150"))
def r2(spark, sf):
    c = candidates(spark, sf)
    kinds = [groom.GHOST, groom.MISSING_TYPE, groom.ORPHAN, groom.BAD_EDGE, groom.DUPLICATE]
    out = None
    for kind in kinds:
        kept = repair.apply_cap(c.where(F.col("kind") == kind))
        out = kept if out is None else out.unionByName(kept)
    return out


CONFIRM_SQL = cand_sql(
    "SELECT kind, id FROM cand",
).replace("FROM chk WHERE parent_type IS NOT NULL AND n_parents = 0", f"FROM chk WHERE parent_type IS NOT NULL AND n_parents = 0 {IN_WINDOW}"
          ).replace("FROM chk WHERE key_bad AND NOT uri_ok", f"FROM chk WHERE key_bad AND NOT uri_ok {IN_WINDOW}"
                    ).replace("UNION ALL SELECT DISTINCT 'Bad Edge', eid FROM bad",
                              """UNION ALL SELECT DISTINCT 'Bad Edge', eid FROM bad JOIN ends USING (eid) JOIN chk ON chk.vid = ends.vid
    WHERE NOT (key_bad AND NOT uri_ok) """ + IN_WINDOW)


@query("r3_confirm", CONFIRM_SQL)
def r3(spark, sf):
    return repair.confirm(candidates(spark, sf), candidates(spark, sf, MONTHS_6))


@query("r4_confirm_dupes", dupe_sql("""
SELECT DISTINCT keeper_vid, mem.vid FROM mem JOIN keep USING (group_id, parent_vid)
WHERE keeper_vid IS NOT NULL AND mem.vid <> keeper_vid AND mem.node_type = 'lineitem'"""))
def r4(spark, sf):
    """Run 2 looks at the graph without its parts; their groups are gone by then."""
    g = graph(spark, sf)
    rest = g.v.where(~F.coalesce(F.col("node_type") == "part", F.lit(False)))
    groups = dupes.find_dupe_groups(rest, g.e, g.nt)
    second = dupes.with_keeper(groups, dupes.choose_keeper(groups, rest, g.e, g.nt))
    return dupes.confirm_dupes(found(spark, sf).dupes, second)


BROKEN = """
gone AS (SELECT id::BIGINT AS vid FROM cand WHERE kind IN ('Orphan', 'Phantom'))"""


def broken_vertices(spark, sf):
    return candidates(spark, sf).where(F.col("kind").isin(groom.ORPHAN, groom.GHOST)).select(
        F.col("id").cast("long").alias("vid"))


@query("r5_delete_vertices", cand_sql("SELECT vid, node_type FROM v WHERE vid NOT IN (SELECT vid FROM gone)", BROKEN))
def r5(spark, sf):
    g = graph(spark, sf)
    return repair.delete_vertices(g.v, g.e, broken_vertices(spark, sf))[0].select("vid", "node_type")


@query("r5_delete_vertices_edges", cand_sql(
    "SELECT eid FROM e WHERE src NOT IN (SELECT vid FROM gone) AND dst NOT IN (SELECT vid FROM gone)", BROKEN))
def r5b(spark, sf):
    g = graph(spark, sf)
    return repair.delete_vertices(g.v, g.e, broken_vertices(spark, sf))[1].select("eid")


FIXED = """
dead AS (SELECT DISTINCT bad_vid AS vid FROM bad WHERE reason <> 'absent'),
cutoff AS (SELECT DISTINCT eid FROM bad WHERE reason = 'absent')"""


@query("r6_fix_bad_edges", chk("""
SELECT eid FROM e WHERE src NOT IN (SELECT vid FROM dead) AND dst NOT IN (SELECT vid FROM dead)
  AND eid NOT IN (SELECT eid FROM cutoff)""", bad_edge_sql(), FIXED))
def r6(spark, sf):
    g = graph(spark, sf)
    return repair.fix_bad_edges(g.v, g.e, found(spark, sf).bad_edges)[1].select("eid")


@query("r6_fix_bad_edges_vertices", chk(
    "SELECT vid, node_type FROM v WHERE vid NOT IN (SELECT vid FROM dead)", bad_edge_sql(), FIXED))
def r6b(spark, sf):
    g = graph(spark, sf)
    return repair.fix_bad_edges(g.v, g.e, found(spark, sf).bad_edges)[0].select("vid", "node_type")


@query("r7_fill_dummy_props", graph_sql("""
SELECT vid, coalesce(node_type, 'part') AS node_type,
  CASE WHEN node_type IS NULL THEN vid||'dummy' ELSE uri END AS uri,
  CASE WHEN node_type IS NULL THEN vid||'dummy' ELSE uuid END AS uuid,
  CASE WHEN node_type IS NULL THEN vid::VARCHAR ELSE props['part-key'] END AS part_key,
  CASE WHEN node_type IS NULL THEN vid||'dummy' ELSE props['part-name'] END AS part_name,
  props['supplier-name'] AS supplier_name FROM v"""))
def r7(spark, sf):
    g = graph(spark, sf)
    return repair.fill_dummy_props(g.v, g.nt, "part").select(
        "vid", "node_type", "uri", "uuid", prop("part-key").alias("part_key"),
        prop("part-name").alias("part_name"), prop("supplier-name").alias("supplier_name"))


WALK = """
deg AS (SELECT vid, count(*) AS n FROM nb GROUP BY 1),
walk(root, depth, node) AS (
  SELECT vid, 0, vid FROM v
  UNION ALL SELECT root, depth + 1, child_vid FROM walk JOIN tree ON parent_vid = node WHERE depth < 15),
dsc AS (SELECT root AS vid, count(*) AS n FROM walk WHERE depth > 0 GROUP BY 1)"""


@query("r8_guard_delete", graph_sql("""
SELECT v.vid, node_type, coalesce(deg.n, 0) AS n_edges, coalesce(dsc.n, 0) AS n_descendants,
  concat_ws('|', CASE WHEN dsc.n > 10 THEN 'descendants' END, CASE WHEN deg.n > 10 THEN 'edges' END,
    CASE WHEN node_type = 'customer' THEN 'protected_type' END) AS reasons,
  coalesce(dsc.n, 0) <= 10 AND coalesce(deg.n, 0) <= 10 AND coalesce(node_type, '') <> 'customer' AS allowed
FROM v LEFT JOIN deg USING (vid) LEFT JOIN dsc USING (vid)""", WALK, recursive=True))
def r8(spark, sf):
    g = graph(spark, sf)
    return repair.guard_delete(g.v, g.e, g.v, protected=("customer",))


@query("r9_collect_data", graph_sql("""
SELECT v.vid, uri, coalesce(deg.n, 0) AS n_edges, coalesce(dsc.n, 0) AS n_descendants
FROM v LEFT JOIN deg USING (vid) LEFT JOIN dsc USING (vid) WHERE props['market-segment'] = 'BUILDING'""",
                                    WALK, recursive=True))
def r9(spark, sf):
    g = graph(spark, sf)
    return repair.collect_data(g.v, g.e, spec="market-segment|BUILDING")[0].select(
        "vid", "uri", "n_edges", "n_descendants")


@query("r9_collect_data_edges", graph_sql("""
SELECT nb.vid, other_vid, o.node_type AS other_type FROM nb JOIN v USING (vid) LEFT JOIN v o ON o.vid = other_vid
WHERE v.props['market-segment'] = 'BUILDING'"""))
def r9b(spark, sf):
    g = graph(spark, sf)
    return repair.collect_data(g.v, g.e, spec="market-segment|BUILDING")[1].select("vid", "other_vid", "other_type")


@query("r10_delete_edges", chk("SELECT eid, src, dst, label FROM e WHERE eid NOT IN (SELECT eid FROM bad)",
                               bad_edge_sql()))
def r10(spark, sf):
    return repair.delete_edges(graph(spark, sf).e, found(spark, sf).bad_edges)[0].select("eid", "src", "dst", "label")


@query("r10_delete_edges_report", chk("""
SELECT DISTINCT eid, src, dst, label, 'deleted' AS status FROM e WHERE eid IN (SELECT eid FROM bad)""", bad_edge_sql()))
def r10b(spark, sf):
    return repair.delete_edges(graph(spark, sf).e, found(spark, sf).bad_edges)[1]
