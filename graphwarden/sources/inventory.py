"""Network-inventory graph derived from the star-schema tables, input of the recipe queries.

Each customer becomes a server with its VNF, service and links, each supplier a
network device with ports, each order an evc with its path, each part a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphwarden.functions.keys import empty_props
from graphwarden.functions.storage import configure, cut
from graphwarden.model import EDGE_COLS, EDGE_RULE_DDL, Graph, NODE_TYPE_DDL, VERTEX_COLS
from graphwarden.sources.tables import BASE

# Id codes of the inventory types.
CODE = {
    "cloud-region": 31, "network-technology": 32, "pserver": 33, "pnf": 34, "port": 35, "forwarding-path": 37,
    "forwarder": 38, "configuration": 39, "forwarder-evc": 40, "evc": 41, "generic-vnf": 42, "licence": 43,
    "service-instance": 45, "vnf-configuration": 46, "vserver": 47, "vf-module": 48, "model": 50, "model-ver": 51,
    "named-query-element": 52, "model-element": 53, "image": 54, "tenant": 55, "vlan-tag": 56, "server-port": 57,
    "physical-link": 58, "l-interface": 59, "complex": 60, "service-subscription": 61, "customer": 62,
    "tunnel-instance": 63, "allotted-resource": 64, "tunnel-xconnect": 65, "vnfc": 66, "instance-group": 67,
    "evc-instance": 68,
}
SUBSCRIPTIONS = {0: "TYPE-A", 1: "TYPE-B", 2: "TYPE-C"}
NODE_TYPES = [
    (t, [k], [] if top else ["pserver"], top, [k], [], [], [], {k: "String"}, u)
    for t, k, top, u in [
        ("pserver", "hostname", True, "/pservers/pserver/{hostname}"),
        ("pnf", "pnf-name", True, "/network/pnfs/pnf/{pnf-name}"),
        ("p-interface", "interface-name", False, "/p-interfaces/p-interface/{interface-name}"),
        ("lag-interface", "interface-name", False, "/lag-interfaces/lag-interface/{interface-name}"),
        ("l-interface", "interface-name", False, "/l-interfaces/l-interface/{interface-name}"),
    ]
]
EDGE_RULES = [("vnfc", "vf-module", "Uses", "OUT", "MANY2MANY", "NONE", "OUT", "IN", True, False)] + [
    (a, b, label, "OUT", "MANY2ONE", "IN", "IN", "NONE", True, False) for a, b, label in [
        ("p-interface", "pnf", "BindsTo"), ("forwarder", "forwarding-path", "BelongsTo"), ("forwarder-evc", "configuration", "BelongsTo"),
        ("service-instance", "service-subscription", "BelongsTo"), ("evc", "configuration", "BelongsTo"),
        ("vlan-range", "cloud-region", "BelongsTo"), ("vlan-tag", "vlan-range", "BelongsTo")]
] + [
    ("forwarder", "p-interface", "ForwardsTo", "OUT", "MANY2MANY", "NONE", "NONE", "IN", True, False),
    ("forwarder", "lag-interface", "ForwardsTo", "OUT", "MANY2MANY", "NONE", "NONE", "IN", True, False),
    ("forwarder", "configuration", "Uses", "OUT", "ONE2ONE", "NONE", "OUT", "NONE", True, False),
    ("forwarding-path", "configuration", "Uses", "OUT", "ONE2MANY", "NONE", "OUT", "NONE", True, False),
    ("forwarding-path", "service-instance", "AppliesTo", "OUT", "MANY2MANY", "NONE", "NONE", "IN", True, False),
    ("network-technology", "cloud-region", "Uses", "IN", "MANY2MANY", "NONE", "NONE", "OUT", True, False),
    ("vserver", "image", "Uses", "OUT", "MANY2ONE", "NONE", "NONE", "IN", True, False),
] + [
    (t, "model-ver", "IsA", "OUT", "MANY2ONE", "NONE", "NONE", "IN", True, True)
    for t in ("generic-vnf", "service-instance", "vf-module")
]


def vid(kind: str, key: Column | str) -> Column:
    return (F.lit(CODE[kind] * BASE) + (F.col(key) if isinstance(key, str) else key)).cast("long")


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _v(df: DataFrame, kind: str, key, props: dict, uri: Column | None = None, node_type=None, source="X",
       version=None) -> DataFrame:
    null = F.lit(None)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    bag = F.map_filter(F.create_map(*[x for n, c in props.items() for x in (F.lit(n), lit(c).cast("string"))]),
                       lambda _, x: x.isNotNull()) if props else empty_props()
    cols = {"vid": vid(kind, key), "node_type": lit(node_type if node_type is not None else kind),
            "uri": uri if uri is not None else text(f"/{kind}/", F.col(key) if isinstance(key, str) else key),
            "uuid": F.md5(vid(kind, key).cast("string").cast("binary")),
            "resource_version": lit(version if version is not None else "1").cast("string"),
            "created_ts": null.cast("long"), "last_mod_ts": null.cast("long"), "end_ts": null.cast("long"),
            "source_of_truth": lit(source), "props": bag}
    return df.select(*[cols[c].alias(c) for c in VERTEX_COLS])


def _e(df: DataFrame, label: str, src: Column, dst: Column, contains: str = "NONE") -> DataFrame:
    cols = {"eid": F.concat_ws(":", F.lit(label), src, dst), "src": src, "dst": dst, "label": F.lit(label),
            "contains_other_v": F.lit(contains), "delete_other_v": F.lit("NONE"), "prevent_delete": F.lit("NONE"),
            "end_ts": F.lit(None).cast("long"), "props": empty_props()}
    return df.select(*[cols[c].alias(c) for c in EDGE_COLS])


def port_name(p: Column) -> Column:
    return F.when(p == 4, "ae4").otherwise(text("1.", p))


def port_exists(s: Column, p: Column) -> Column:
    return ~((p == 3) & (s % 5 == 0))


def order_ports(orders: DataFrame, n_pnf: int) -> DataFrame:
    """Orders with the device and port of their two sides (s1, p1 and s2, p2)."""
    o = F.col("o_orderkey")
    return orders.select("*", (o % n_pnf).alias("s1"), (F.floor(o / 7) % 5).alias("p1"),
                         ((o + 1) % n_pnf).alias("s2"), (F.floor(o / 5) % 5).alias("p2"))


def hostname(c: Column) -> Column:
    tail = F.when(c % 4 == 0, "a").when(c % 4 == 1, "bb").when(c % 4 == 2, "ccc").otherwise("dddd")
    return F.when(c % 7 == 0, text("nodot", c)).otherwise(text("h", F.floor(c / 4), ".", tail))


def derive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer, supplier, part, orders, nation = (read(t) for t in ("customer", "supplier", "part", "orders", "nation"))
    n_pnf, n_part = supplier.count(), part.count()
    c, s, p, o, n = (F.col(x) for x in ("c_custkey", "s_suppkey", "p_partkey", "o_orderkey", "n_nationkey"))
    vs, es = [], []

    # regions, technologies, places
    owner = text("owner", F.col("n_regionkey"))
    vs += [_v(nation, "cloud-region", n, {"cloud-owner": owner, "cloud-region-id": F.col("n_name")}),
           _v(nation, "tenant", n, {"tenant-id": n}), _v(nation, "complex", n, {"physical-location-id": n})]
    es += [_e(nation, "BelongsTo", vid("tenant", n), vid("cloud-region", n), "IN")]
    images = nation.select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    vs += [_v(images, "image", n * 10 + F.col("j"), {"image-name": text("img", F.col("j"))})]
    es += [_e(images, "BelongsTo", vid("image", n * 10 + F.col("j")), vid("cloud-region", n), "IN")]
    brands = part.select(F.col("p_brand"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long").alias("b")).distinct()
    vs += [_v(brands, "network-technology", "b", {"network-technology-id": F.col("b"), "network-technology-name": F.col("p_brand")})]

    # devices and their ports
    kind = F.when(s % 3 == 0, "Switch").when(s % 3 == 1, "switch").otherwise("Router")
    pnf_uri = text("/network/pnfs/pnf/pnf", s)
    vs += [_v(supplier, "pnf", s, {"pnf-name": text("pnf", s), "equip-type": kind}, pnf_uri),
           _v(supplier, "instance-group", s, {"id": text("ig", s), "type": text("t", s % 3), "sub-type": text("u", s % 2),
                                              "model-invariant-id": text("inv", s)})]
    ports = supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    ports = ports.where(port_exists(s, F.col("k")))
    lag = F.col("k") == 4
    port_kind = F.when(lag, "lag-interface").otherwise("p-interface")
    vs += [_v(ports, "port", s * 10 + F.col("k"), {"interface-name": port_name(F.col("k"))},
              F.concat(pnf_uri, F.when(lag, "/lag-interfaces/lag-interface/").otherwise("/p-interfaces/p-interface/"),
                       port_name(F.col("k"))), port_kind, F.when(F.col("k") == 2, "FEED").otherwise("X"))]
    es += [_e(ports, "BindsTo", vid("port", s * 10 + F.col("k")), vid("pnf", s), "IN")]

    # evcs and their paths
    evc = text("evc", o)
    paths = orders.where(o % 11 != 0)
    vs += [_v(paths, "forwarding-path", o, {"forwarding-path-id": evc})]
    sides = order_ports(paths, n_pnf).where(o % 3 != 0)
    two = sides.select("*", F.explode(F.when(o % 3 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("q"))
    q = F.col("q")
    two = two.withColumn("dev", F.when(q == 1, F.col("s1")).otherwise(F.col("s2"))).withColumn(
        "prt", F.when(q == 1, F.col("p1")).otherwise(F.col("p2")))
    key = o * 10 + q
    svlan = F.when(o % 13 != 0, F.when(o % 2 == 0, text("0", o % 50)).otherwise(text(o % 50)))
    vs += [_v(two, "forwarder", key, {"sequence": q, "forwarder-role": F.when(q == 1, "ingress").otherwise("egress")}),
           _v(two, "configuration", key, {"configuration-id": text(evc, "-", q)}),
           _v(two, "forwarder-evc", key, {
               "forwarder-evc-id": text(evc, "-", q), "circuit-id": F.when((q == 1) & (o % 4 != 0), text("c", o)),
               "svlan": svlan, "ivlan": F.when(o % 5 == 0, "7")})]
    es += [_e(two, "BelongsTo", vid("forwarder", key), vid("forwarding-path", o), "IN"),
           _e(two.where(port_exists(F.col("dev"), F.col("prt"))), "ForwardsTo", vid("forwarder", key),
              vid("port", F.col("dev") * 10 + F.col("prt"))),
           _e(two, "Uses", vid("forwarder", key), vid("configuration", key)),
           _e(two, "BelongsTo", vid("forwarder-evc", key), vid("configuration", key), "IN")]
    evcs = orders.where("o_orderstatus <> 'P'").select("*", F.explode(F.when(
        o % 50 == 0, F.array(F.lit(0), F.lit(BASE // 2))).otherwise(F.array(F.lit(0).cast("long")))).alias("shift"))
    vs += [_v(evcs, "evc", o + F.col("shift"), {"evc-id": evc})]
    old_si = orders.where(o % 17 == 0)
    vs += [_v(old_si, "evc-instance", o, {"service-instance-id": evc}, node_type="service-instance")]
    es += [_e(old_si, "BelongsTo", vid("evc-instance", o), vid("service-subscription", F.lit(2)), "IN"),
           _e(paths.where(o % 34 == 0), "AppliesTo", vid("forwarding-path", o), vid("evc-instance", o))]
    tags = orders.where("o_orderstatus = 'O'")
    vs += [_v(tags, "vlan-tag", o, {"vlan-tag-id": text("t", o)}, text("/vlan-tags/vlan-tag/t", o))]
    es += [_e(tags, "Uses", vid("vlan-tag", o), vid("generic-vnf", F.col("o_custkey")))]

    # VNFs, licences, services, modules
    vnf_type = F.element_at(F.array(*[F.lit(x) for x in ("HN", "HP", "HG", "XX")]), (c % 4 + 1).cast("int"))
    local = c % 2 == 0
    vs += [_v(customer, "generic-vnf", c, {
        "vnf-id": text("vnf", c), "vnf-name": text("name", c), "vnf-type": vnf_type,
        "is-closed-loop-disabled": F.when(c % 5 == 0, "true"), "management-option": F.when(c % 6 == 0, "own"),
        "model-invariant-id-local": F.when(local, text("inv", c % n_part)),
        "model-version-id-local": F.when(local, F.when(c % 10 == 0, "verX").otherwise(text("ver", c % n_part)))})]
    licence = F.when(o % 2 == 0, "entitlement").otherwise("license")
    vs += [_v(orders, "licence", o, {"group-uuid": text("g", o % 5), "resource-uuid": text("r", o)},
              text("/vnfs/vnf", F.col("o_custkey"), "/licences/r", o), licence)]
    es += [_e(orders, "BelongsTo", vid("licence", o), vid("generic-vnf", F.col("o_custkey")), "IN")]
    vs += [_v(customer, "service-instance", c, {"service-instance-id": text("si", c)}),
           _v(customer, "vnf-configuration", c, {"configuration-id": text("vc", c)}, node_type="configuration"),
           _v(customer, "vserver", c, {"vserver-id": text("vs", c)}), _v(customer, "vf-module", c, {"vf-module-id": text("vf", c)}),
           _v(customer, "vnfc", c, {"vnfc-name": text("vnfc", c), "model-invariant-id": text("inv", c),
                                    "model-version-id": F.when(c % 3 == 0, text("ver", c))})]
    es += [_e(customer, "ComposedOf", vid("service-instance", c), vid("generic-vnf", c)),
           _e(customer, "Uses", vid("service-instance", c), vid("vnf-configuration", c)),
           _e(customer, "HostedOn", vid("generic-vnf", c), vid("vserver", c)),
           _e(customer, "HostedOn", vid("vserver", c), vid("pserver", c)),
           _e(customer, "BelongsTo", vid("vf-module", c), vid("generic-vnf", c), "IN"),
           _e(customer, "Uses", vid("vf-module", c), vid("vserver", c)),
           _e(customer, "Uses", vid("vnfc", c), vid("vf-module", c)),
           _e(customer, "BelongsTo", vid("vserver", c), vid("tenant", F.col("c_nationkey")), "IN"),
           _e(customer.where(c % 3 != 0), "Uses", vid("vserver", c), vid("image", F.col("c_nationkey") * 10)),
           _e(customer.where(c % 4 == 0), "IsA", vid("generic-vnf", c), vid("model-ver", c % n_part))]

    # servers, their ports and links
    rct = c % 4 < 2
    vs += [_v(customer, "pserver", c, {
        "hostname": hostname(c), "fqdn": F.when(rct, text("h", F.floor(c / 4), ".fq")),
        "equip-type": F.when(c % 2 == 0, "Server").otherwise("VM")}, text("/pservers/pserver/", hostname(c)),
        source=F.when(rct, "SRC-A").otherwise("SRC-B"), version=c * 37 % 1000)]
    sp = customer.select("c_custkey", F.explode(F.when(c % 3 == 0, F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(1)))).alias("j"))
    j = F.col("j")
    vs += [_v(sp, "server-port", c * 10 + j, {"interface-name": text("ge/", j + 10)},
              text("/pservers/pserver/", hostname(c), "/p-interfaces/p-interface/ge%2F", j + 10), "p-interface")]
    es += [_e(sp, "BindsTo", vid("server-port", c * 10 + j), vid("pserver", c), "IN")]
    lk = sp.where(c % 5 != 0)
    vs += [_v(lk, "physical-link", c * 10 + j, {"link-name": text(hostname(c), ":ge", j, "|aa", c, ":1")})]
    es += [_e(lk, "LinksTo", vid("server-port", c * 10 + j), vid("physical-link", c * 10 + j))]
    vs += [_v(customer, "l-interface", c, {"interface-name": text("l", c)},
              text("/pservers/pserver/", hostname(c), "/p-interfaces/p-interface/ge%2F10/l-interfaces/l-interface/l", c))]
    es += [_e(customer, "BelongsTo", vid("l-interface", c), vid("server-port", c * 10), "IN"),
           _e(customer, "LocatedIn", vid("pserver", c), vid("complex", F.col("c_nationkey")))]

    # subscriptions, tunnels
    subs = nation.where("n_nationkey < 3")
    sub_type = F.element_at(F.array(*[F.lit(x) for x in SUBSCRIPTIONS.values()]), (n + 1).cast("int"))
    vs += [_v(subs, "service-subscription", n, {"service-type": sub_type}),
           _v(nation.where("n_nationkey = 0"), "customer", n, {"global-customer-id": "G1"}),
           _v(customer, "tunnel-instance", c, {"service-instance-id": text("vi", c)}, node_type="service-instance"),
           _v(customer, "allotted-resource", c, {"id": text("ar", c)}),
           _v(customer, "tunnel-xconnect", c, {
               "id": text("tx", c), "bandwidth-up-wan1": text(c, " Mbps"), "bandwidth-down-wan1": text("d", c + 1),
               "bandwidth-up-wan2": F.when(c % 4 != 0, text(c + 2)), "bandwidth-down-wan2": text(c + 3)})]
    es += [_e(subs, "BelongsTo", vid("service-subscription", n), vid("customer", F.lit(0)), "IN"),
           _e(customer.where(c % 2 == 0), "BelongsTo", vid("service-instance", c), vid("service-subscription", F.lit(0)), "IN"),
           _e(customer, "BelongsTo", vid("tunnel-instance", c), vid("service-subscription", F.lit(1)), "IN"),
           _e(customer, "BelongsTo", vid("allotted-resource", c), vid("tunnel-instance", c), "IN"),
           _e(customer, "Uses", vid("service-instance", c), vid("allotted-resource", c)),
           _e(customer, "BelongsTo", vid("tunnel-xconnect", c), vid("allotted-resource", c), "IN")]

    # models
    ver_uri = text("/service-design-and-creation/models/model/inv", p, "/model-vers/model-ver/ver", p)
    vs += [_v(part, "model", p, {"model-invariant-id": text("inv", p),
                                 "model-type": F.when(p % 2 == 0, "widget").otherwise("resource")}),
           _v(part, "model-ver", p, {"model-version-id": text("ver", p), "model-name": F.col("p_name"),
                                     "model-version": text("1.", p % 3)}, ver_uri),
           _v(part.where(p % 4 == 0), "named-query-element", p, {"id": text("nq", p)}),
           _v(part.where(p % 3 == 0), "model-element", p, {"id": text("me", p)})]
    es += [_e(part, "BelongsTo", vid("model-ver", p), vid("model", p), "IN"),
           _e(part.where(p % 4 == 0), "IsA", vid("named-query-element", p), vid("model", p)),
           _e(part.where(p % 3 == 0), "BelongsTo", vid("model-element", p), vid("model-ver", p), "IN"),
           _e(part.where(p % 3 == 0), "IsA", vid("model-element", p), vid("model-ver", (p + 1) % n_part))]

    union = lambda frames: frames[0] if len(frames) == 1 else union(frames[:len(frames) // 2]).unionByName(
        union(frames[len(frames) // 2:]))
    return union(vs), union(es)


_graphs: dict[tuple[str, str], Graph] = {}


def inventory(spark: SparkSession, sf_dir: str) -> Graph:
    """The inventory as written tables, built once per session."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        v, e = derive(spark, sf_dir)
        _graphs[key] = Graph(
            cut(v, "vertices", ("node_type",)), cut(e, "edges", ("label",)),
            spark.createDataFrame(NODE_TYPES, NODE_TYPE_DDL), spark.createDataFrame(EDGE_RULES, EDGE_RULE_DDL))
    return _graphs[key]
