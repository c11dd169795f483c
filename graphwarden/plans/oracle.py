"""SQL restatement of the derived graph, shared by the checks of all queries."""

from __future__ import annotations

GRAPH_CTES = """
li AS MATERIALIZED (
  SELECT l.*, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
    count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies,
    o_custkey, CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) END AS ended
  FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
rawv(node_type, key, vid, uri, created_ts, end_ts, src_truth, props) AS (
  SELECT 'region', r_regionkey::BIGINT, 1*10**15::BIGINT + r_regionkey, '/regions/region/'||r_regionkey,
    NULL::BIGINT, NULL::BIGINT, 'MDM', MAP {'region-key': r_regionkey::VARCHAR, 'name': r_name} FROM region
  UNION ALL
  SELECT 'nation', n_nationkey::BIGINT, 2*10**15 + n_nationkey,
    '/regions/region/'||n_regionkey||'/nations/nation/'||n_nationkey,
    NULL, NULL, 'MDM', MAP {'nation-key': n_nationkey::VARCHAR, 'name': n_name} FROM nation
  UNION ALL
  SELECT 'customer', c_custkey, 3*10**15 + c_custkey,
    CASE WHEN c_custkey % 202 = 0 THEN '' ELSE '/customers/customer/'||c_custkey END, NULL, NULL, 'CRM',
    CASE WHEN c_custkey % 101 = 0 THEN MAP {'customer-name': c_name, 'market-segment': c_mktsegment}
      ELSE MAP {'customer-key': c_custkey::VARCHAR, 'customer-name': c_name, 'market-segment': c_mktsegment} END
  FROM customer
  UNION ALL
  SELECT CASE WHEN s_suppkey % 37 <> 0 THEN 'supplier' END, s_suppkey, 4*10**15 + s_suppkey,
    '/suppliers/supplier/'||s_suppkey, NULL, NULL, 'SRM',
    CASE WHEN s_suppkey % 3 = 0
      THEN MAP {'supplier-key': s_suppkey::VARCHAR, 'supplier-name': s_name, 'in-maint': 'true'}
      ELSE MAP {'supplier-key': s_suppkey::VARCHAR, 'supplier-name': s_name} END
  FROM supplier
  UNION ALL
  SELECT 'part', p_partkey, 5*10**15 + p_partkey + shift, '/parts/part/'||p_partkey, NULL, NULL, 'PIM',
    MAP {'part-key': p_partkey::VARCHAR, 'part-name': p_name, 'brand': p_brand, 'equip-type': p_type,
         'size': p_size::VARCHAR}
  FROM part JOIN (VALUES (0::BIGINT), (5*10**14)) s(shift) ON shift = 0 OR p_partkey % 89 = 0
  UNION ALL
  SELECT 'order', o.o_orderkey, 6*10**15 + o.o_orderkey,
    CASE WHEN o.o_orderkey % 103 = 1 AND p.o_orderkey IS NOT NULL
      THEN '/customers/customer/'||p.o_custkey||'/orders/order/'||p.o_orderkey
      ELSE '/customers/customer/'||o.o_custkey||'/orders/order/'||o.o_orderkey END,
    epoch_ms(o.o_orderdate), CASE WHEN o.o_orderstatus = 'F' THEN epoch_ms(o.o_orderdate) END, 'ERP',
    MAP {'order-key': o.o_orderkey::VARCHAR, 'order-status': o.o_orderstatus, 'priority': o.o_orderpriority}
  FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey - 1
  UNION ALL
  SELECT 'lineitem', rn, 7*10**15 + rn + shift,
    '/customers/customer/'||o_custkey||'/orders/order/'||l_orderkey||'/lineitems/lineitem/'||l_linenumber,
    NULL, ended, 'ERP',
    MAP {'line-number': l_linenumber::VARCHAR, 'quantity': l_quantity::BIGINT::VARCHAR,
         'return-flag': l_returnflag, 'line-status': l_linestatus}
  FROM li JOIN (VALUES (0::BIGINT), (5*10**14)) s(shift)
    ON shift = 0 OR (l_orderkey % 131 = 2 AND copies = 1)),
v AS MATERIALIZED (
  SELECT vid::BIGINT AS vid, node_type, uri, md5(coalesce(node_type, 'supplier')||':'||key) AS uuid,
    (key * 10 + 1)::VARCHAR AS resource_version, created_ts, created_ts AS last_mod_ts, end_ts,
    src_truth AS source_of_truth, props
  FROM rawv),
rawe(label, src, dst, end_ts) AS (
  SELECT 'BelongsTo', 2*10**15 + n_nationkey, 1*10**15 + n_regionkey, NULL::BIGINT FROM nation
  UNION ALL
  SELECT 'BelongsTo', 6*10**15 + o_orderkey, 3*10**15 + o_custkey,
    CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) END FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT 'BelongsTo', 6*10**15 + o_orderkey, 3*10**15 + (o_custkey + 1) % (SELECT count(*) FROM customer),
    CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) END FROM orders WHERE o_orderkey % 127 = 1
  UNION ALL
  SELECT 'BelongsTo', 7*10**15 + rn + shift, 6*10**15 + l_orderkey, ended
  FROM li JOIN (VALUES (0::BIGINT), (5*10**14)) s(shift)
    ON shift = 0 OR (l_orderkey % 131 = 2 AND copies = 1)
  UNION ALL
  SELECT 'Uses', 7*10**15 + rn, 5*10**15 + l_partkey + shift, ended
  FROM li JOIN (VALUES (0::BIGINT), (5*10**14)) s(shift)
    ON shift = 0 OR (l_partkey % 89 = 0 AND l_orderkey % 2 = 0)
  UNION ALL
  SELECT 'Uses', 7*10**15 + rn,
    CASE WHEN l_orderkey % 113 = 0 THEN 9*10**15 ELSE 4*10**15 END + l_suppkey, ended FROM li
  UNION ALL
  SELECT 'LocatedIn', 3*10**15 + c_custkey, 2*10**15 + c_nationkey, NULL FROM customer
  UNION ALL
  SELECT 'LocatedIn', 4*10**15 + s_suppkey, 2*10**15 + s_nationkey, NULL FROM supplier),
e AS MATERIALIZED (
  SELECT label||':'||src::BIGINT||':'||dst::BIGINT AS eid, src::BIGINT AS src, dst::BIGINT AS dst, label,
    CASE label WHEN 'BelongsTo' THEN 'IN' ELSE 'NONE' END AS contains_other_v,
    'NONE' AS delete_other_v, CASE label WHEN 'Uses' THEN 'IN' ELSE 'NONE' END AS prevent_delete, end_ts
  FROM rawe),
nt(node_type, key_prop, parent_type, top_level) AS (VALUES
  ('region', 'region-key', NULL, true), ('nation', 'nation-key', 'region', false),
  ('customer', 'customer-key', NULL, true), ('supplier', 'supplier-key', NULL, true),
  ('part', 'part-key', NULL, true), ('order', 'order-key', 'customer', false),
  ('lineitem', 'line-number', 'order', false)),
rules(from_type, to_type, label, contains_other_v, delete_other_v, prevent_delete) AS (VALUES
  ('nation', 'region', 'BelongsTo', 'IN', 'IN', 'NONE'), ('order', 'customer', 'BelongsTo', 'IN', 'IN', 'NONE'),
  ('lineitem', 'order', 'BelongsTo', 'IN', 'IN', 'NONE'), ('lineitem', 'part', 'Uses', 'NONE', 'NONE', 'IN'),
  ('lineitem', 'supplier', 'Uses', 'NONE', 'NONE', 'IN'),
  ('customer', 'nation', 'LocatedIn', 'NONE', 'NONE', 'NONE'),
  ('supplier', 'nation', 'LocatedIn', 'NONE', 'NONE', 'NONE')),
tree AS (
  SELECT dst AS parent_vid, src AS child_vid, eid FROM e WHERE contains_other_v = 'IN'
  UNION ALL SELECT src, dst, eid FROM e WHERE contains_other_v = 'OUT'),
nb AS (SELECT src AS vid, dst AS other_vid, eid FROM e UNION ALL SELECT dst, src, eid FROM e)
"""


def graph_sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """``body`` over the derived graph; ``ctes`` are extra ``name AS (...)`` parts."""
    parts = ",\n".join([GRAPH_CTES.strip(), *[c.strip() for c in ctes]])
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body.strip()}"


# What grooming knows about each vertex of a known type.
CHECKS_CTES = """
owner AS (SELECT min(vid) AS vid FROM v WHERE uri <> '' GROUP BY uri),
npar AS (SELECT child_vid AS vid, count(*) AS n FROM tree GROUP BY 1),
chk AS MATERIALIZED (
  SELECT v.vid, v.node_type, v.uri, v.uuid, v.last_mod_ts, parent_type, coalesce(npar.n, 0) AS n_parents,
    owner.vid IS NOT NULL AS uri_ok, coalesce(props[key_prop], '') <> '' AS has_keys,
    CASE WHEN coalesce(props[key_prop], '') <> '' THEN false
         WHEN parent_type IS NULL THEN true ELSE coalesce(npar.n, 0) = 1 END AS key_bad
  FROM v JOIN nt USING (node_type) LEFT JOIN owner USING (vid) LEFT JOIN npar USING (vid))
"""
