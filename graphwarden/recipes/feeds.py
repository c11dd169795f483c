"""Feed-driven recipes.

Every feed comes as a DataFrame of named text columns, as the feed reader
returns it; ``line`` numbers its rows where the order matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.keys import prop, set_prop
from graphwarden.functions.numbering import number_rows
from graphwarden.functions.storage import cut, written
from graphwarden.model import Graph
from graphwarden.operators.migrate import Outcome
from graphwarden.operators.repair import delete_vertices
from graphwarden.operators.structure import tree
from graphwarden.recipes.common import (
    Labels, Step, fallout, make_edges, make_vertices, next_vid, pick, update_props, walk)

# Fixed values of the recipes.
BANDWIDTH_VNF_TYPE = "HN"
INGRESS, EGRESS, INTERMEDIATE = "ingress", "egress", "intermediate"
RATE_UNIT_LENGTH = 4
PATH_TOPOLOGY = "PointToPoint"
TUNNEL_PORTS = {"10": "wan1", "11": "wan2"}
TUNNEL_UNITS = "Mbps"
REGION_URI = "/cloud-infrastructure/cloud-regions/cloud-region/"


def licence_ids(g: Graph, feed: DataFrame) -> Outcome:
    """Entitlements and licences of a VNF and group take the feed's resource uuid, also as URI tail.

    ``feed``: line, resource_uuid, group_uuid, vnf_id; the first line of a (VNF,
    group) counts; more than one match is left alone.
    """
    first = feed.groupBy("vnf_id", "group_uuid").agg(F.min_by("resource_uuid", "line").alias("new"))
    boxes = pick(g.v, "generic-vnf", vnf_id="vnf-id").withColumnRenamed("vid", "parent_vid")
    kids = g.v.where(F.col("node_type").isin("entitlement", "license")).select(
        F.col("vid").alias("child_vid"), "node_type", prop("group-uuid").alias("group_uuid"),
        prop("resource-uuid").alias("old"), "uri")
    owned = tree(g.e).join(boxes, "parent_vid").join(kids, "child_vid")
    rows = written(owned.join(first, ["vnf_id", "group_uuid"]), "licences")
    single = rows.groupBy("vnf_id", "group_uuid", "node_type").agg(
        F.count("*").alias("n"), F.min("child_vid").alias("vid"), F.min("new").alias("new"), F.min("old").alias("old"))
    hit = single.where("n = 1 AND old IS NOT NULL").groupBy("vid").agg(F.min("new").alias("new"), F.min("old").alias("old"))
    v = update_props(g.v, hit, {"resource-uuid": "new"})
    tail = v.join(hit, "vid", "left")
    uri = F.when(F.col("new").isNotNull() & F.endswith("uri", F.col("old")),
                 F.concat(F.regexp_extract("uri", "^(.*/|)[^/]*$", 1), F.col("new"))).otherwise(F.col("uri"))
    v = tail.select(*[uri.alias("uri") if c == "uri" else F.col(c) for c in g.v.columns])
    none = first.join(rows.select("vnf_id", "group_uuid"), ["vnf_id", "group_uuid"], "left_anti")
    bad = fallout(single.where("n > 1"), "vnf_id", "more than one match").unionByName(
        fallout(none, "vnf_id", "no match"))
    return Outcome(v, g.e, hit.select("vid"), bad)


def vendor_bandwidth(g: Graph, feed: DataFrame, labels: Labels = Labels()) -> Outcome:
    """Configurations four hops from an entitlement take its bandwidth (``group_uuid``, ``bandwidth``);
    of several the last line counts."""
    last = feed.groupBy("group_uuid").agg(F.max_by("bandwidth", "line").alias("bandwidth"), F.max("line").alias("line"))
    start = pick(g.v, "entitlement", group_uuid="group-uuid").join(last, "group_uuid").select("vid", "line", "bandwidth")
    ends = walk(g.v, g.e, start, [
        Step("out", labels.belongs_to, "generic-vnf", (prop("vnf-type") == BANDWIDTH_VNF_TYPE,)),
        Step("in", labels.composed_of, "service-instance"), Step("out", labels.uses, "configuration")])
    hit = ends.groupBy("vid").agg(F.max_by("bandwidth", "line").alias("bandwidth"))
    return Outcome(update_props(g.v, hit, {"vendor-allowed-max-bandwidth": "bandwidth"}), g.e, hit.select("vid"))


def hub_ivlans(g: Graph, feed: DataFrame, labels: Labels = Labels()) -> Outcome:
    """Forwarder-evcs of an evc take the feed's ivlan where their svlan equals the feed's as a number.

    ``feed``: line, evc, ivlan, svlan; of several matching lines the last counts.
    """
    feed = written(feed.where("evc <> ''"), "hub_feed")
    names = feed.select("evc").distinct()
    start = pick(g.v, "forwarding-path", evc="forwarding-path-id").join(names, "evc")
    ends = walk(g.v, g.e, start, [
        Step("in", labels.belongs_to, "forwarder"), Step("out", labels.uses, "configuration"),
        Step("in", labels.belongs_to, "forwarder-evc")])
    ends = written(ends.join(pick(g.v, "forwarder-evc", have="svlan", now="ivlan"), "vid"), "hub")
    number = lambda c: F.col(c).try_cast("int")
    # lines meet forwarder-evcs on evc and svlan together, never on the evc alone
    last = feed.where("ivlan <> ''").groupBy("evc", number("svlan").alias("sv")).agg(
        F.max_by("ivlan", "line").alias("ivlan"), F.max("line").alias("line"))
    due = ends.withColumn("sv", number("have")).join(last, ["evc", "sv"])
    hit = due.groupBy("vid").agg(F.max_by("ivlan", "line").alias("ivlan"), F.first("now").alias("now")).where(
        F.col("now").isNull() | ((F.col("now") != "") & (number("now") != number("ivlan"))))
    none = feed.join(ends.select("evc").distinct(), "evc", "left_anti")
    bare = ends.where(F.coalesce("have", F.lit("")) == "").select("evc").distinct()
    bad = fallout(none, "line", "no forwarder-evc").unionByName(
        fallout(feed.where("ivlan <> ''").join(bare, "evc", "left_semi"), "line", "no svlan"))
    return Outcome(update_props(g.v, hit, {"ivlan": "ivlan"}), g.e, hit.select("vid"), bad)


def interconnect_types(g: Graph, feed: DataFrame) -> Outcome:
    """The one evc of a name takes the feed's interconnect type (``line``, ``evc``, ``kind``)."""
    rows = feed.where("evc <> '' AND kind <> ''")
    last = rows.groupBy("evc").agg(F.max_by("kind", "line").alias("kind"))
    found = pick(g.v, "evc", evc="evc-id").groupBy("evc").agg(F.count("*").alias("n"), F.min("vid").alias("vid"))
    got = last.join(found, "evc", "left")
    hit = got.where("n = 1")
    bad = rows.join(got.where("n IS NULL").select("evc"), "evc", "left_semi").select(
        F.col("line").cast("string").alias("line"), F.lit("no such evc").alias("reason")).unionByName(
        rows.join(got.where("n > 1").select("evc"), "evc", "left_semi").select(
            F.col("line").cast("string").alias("line"), F.lit("more than one evc").alias("reason")))
    return Outcome(update_props(g.v, hit, {"inter-connect-type-ingress": "kind"}), g.e, hit.select("vid"), bad)


def physical_inventory(g: Graph, feed: DataFrame, labels: Labels = Labels()) -> Outcome:
    """Missing pnfs and their missing p-interfaces are created (``pnf``, ``port``)."""
    rows = feed.where("pnf <> '' AND port <> ''").select("pnf", "port").distinct()
    have = pick(g.v, "pnf", pnf="pnf-name").groupBy("pnf").agg(F.min("vid").alias("pnf_vid"))
    new = rows.select("pnf").distinct().join(have, "pnf", "left_anti")
    base = next_vid(g.v)
    uri = F.concat(F.lit("/network/pnfs/pnf/"), F.col("pnf"))
    made = cut(make_vertices(new, ["pnf"], base, "pnf", {"pnf-name": F.col("pnf")}, uri), "pnfs")
    boxes = have.join(g.v.select(F.col("vid").alias("pnf_vid"), "uri"), "pnf_vid").select("pnf", "pnf_vid", "uri").unionByName(
        made.select("pnf", F.col("vid").alias("pnf_vid"), "uri"))
    ports = tree(g.e).join(pick(g.v, "p-interface", port="interface-name").withColumnRenamed("vid", "child_vid"), "child_vid").join(
        have.withColumnRenamed("pnf_vid", "parent_vid"), "parent_vid").select("pnf", "port")
    fresh = rows.join(ports, ["pnf", "port"], "left_anti").join(boxes.withColumnRenamed("uri", "pnf_uri"), "pnf")
    kids = cut(make_vertices(
        fresh, ["pnf", "port"], next_vid(made) if not made.isEmpty() else base, "p-interface",
        {"interface-name": F.col("port")}, F.concat("pnf_uri", F.lit("/p-interfaces/p-interface/"), "port")), "ports")
    v = g.v.unionByName(made.select(*g.v.columns)).unionByName(kids.select(*g.v.columns))
    e = g.e.unionByName(make_edges(kids, "vid", "pnf_vid", labels.binds_to, "IN", g.rules, ("p-interface", "pnf")))
    return Outcome(v, e, made.select("vid").unionByName(kids.select("vid")))


def _ports(g: Graph) -> DataFrame:
    """(pnf, port, port_vid, n_pnf): interfaces and lag interfaces below each pnf name."""
    boxes = pick(g.v, "pnf", pnf="pnf-name")
    named = boxes.groupBy("pnf").agg(F.count("*").alias("n_pnf"), F.min("vid").alias("parent_vid"))
    kids = g.v.where(F.col("node_type").isin("p-interface", "lag-interface")).select(
        F.col("vid").alias("child_vid"), "node_type", prop("interface-name").alias("port"))
    rows = tree(g.e).join(named, "parent_vid").join(kids, "child_vid")
    return rows.groupBy("pnf", "port", "node_type", "n_pnf").agg(F.min("child_vid").alias("port_vid"))


def valid_ports(g: Graph, feed: DataFrame, sides: list[str]) -> DataFrame:
    """Rows of ``feed`` whose ``<side>_pnf`` exists once and has ``<side>_port``; a port with ``_`` is a lag
    named by the part before it.  Adds ``<side>_vid``."""
    ports = written(_ports(g), "ports").where("n_pnf = 1")
    for s in sides:
        at = F.col(f"{s}_port")
        lag = F.instr(at, "_") > 1
        feed = feed.withColumn("port", F.when(lag, F.substring_index(at, "_", 1)).otherwise(at)).withColumn(
            "node_type", F.when(lag, "lag-interface").otherwise("p-interface")).withColumn("pnf", F.col(f"{s}_pnf"))
        feed = feed.join(ports.drop("n_pnf"), ["pnf", "port", "node_type"]).withColumnRenamed("port_vid", f"{s}_vid").drop(
            "pnf", "port", "node_type")
    return feed


def path_forwarders(g: Graph, feed: DataFrame, labels: Labels = Labels()) -> Outcome:
    """Forwarders, configurations and forwarder-evcs of an evc's path.

    ``feed``: line, evc, and per side (``collector``, ``bearer``) pnf, port, circuit,
    cvlan, svlan.  Ports are numbered per evc in line order, collector first; number 1
    is ingress, a later one with a dot in its name egress, else intermediate.
    """
    sides = ["collector", "bearer"]
    feed = feed.where("evc <> ''")
    ok = written(valid_ports(g, feed, sides), "paths")
    bad = fallout(feed.join(ok.select("line"), "line", "left_anti"), "line", "pnf or port does not exist")

    paths = pick(g.v, "forwarding-path", evc="forwarding-path-id").groupBy("evc").agg(F.min("vid").alias("path_vid"))
    roles = walk(g.v, g.e, paths.select(F.col("path_vid").alias("vid"), "evc"), [Step("in", labels.belongs_to, "forwarder")])
    roles = roles.join(pick(g.v, "forwarder", role="forwarder-role"), "vid").groupBy("evc").agg(
        F.max(F.col("role") == INGRESS).alias("i"), F.max(F.col("role") == EGRESS).alias("e")).where("i AND e").select("evc")
    done = ok.join(roles, "evc", "left_semi")
    lost = ok.join(paths.select("evc"), "evc", "left_anti")
    bad = bad.unionByName(fallout(done, "line", "forwarders exist")).unionByName(fallout(lost, "line", "no forwarding-path"))
    todo = ok.join(roles, "evc", "left_anti").join(paths, "evc")

    both = None
    for i, s in enumerate(sides):
        one = todo.select("evc", "path_vid", "line", F.lit(i).alias("side"), F.col(f"{s}_vid").alias("port_vid"),
                          F.col(f"{s}_port").alias("port"), *[F.col(f"{x}_{c}").alias(f"{x}_{c}")
                                                              for x in sides for c in ("circuit", "cvlan", "svlan")])
        both = one if both is None else both.unionByName(one)
    # the last line naming a port of an evc decides its values, the first its number
    order = F.struct("line", "side")
    cols = [c for c in both.columns if c not in ("evc", "port_vid", "line", "side")]
    port = both.groupBy("evc", "port_vid").agg(
        F.min(order).alias("at"), *[F.max_by(c, order).alias(c) for c in cols])
    port = written(port.select("*", F.col("at.line").alias("l"), F.col("at.side").alias("s")).drop("at"), "forwarders")
    # numbers within an evc: running number minus the evc's first running number
    numbered = written(number_rows(port, ["evc", "l", "s"]), "forwarders")
    starts = numbered.groupBy("evc").agg(F.min("rn").alias("r0"))
    rows = numbered.join(starts, "evc").withColumn("seq", F.col("rn") - F.col("r0") + 1)
    taken = walk(g.v, g.e, paths.select(F.col("path_vid").alias("vid"), "evc"), [Step("in", labels.belongs_to, "forwarder")])
    taken = taken.join(g.e.where(F.col("label") == labels.forwards_to).select(
        F.col("src").alias("vid"), F.col("dst").alias("port_vid")), "vid").select("evc", "port_vid")
    rows = rows.join(taken, ["evc", "port_vid"], "left_anti")
    role = F.when(F.col("seq") == 1, INGRESS).when(F.instr("port", ".") > 1, EGRESS).otherwise(INTERMEDIATE)
    rows = written(rows.withColumn("role", role).withColumn(
        "cid", F.concat_ws("-", "evc", F.col("seq").cast("string"))).drop("rn", "r0"), "forwarders")

    base = next_vid(g.v)
    fwd = make_vertices(rows, ["evc", "seq"], base, "forwarder", {"sequence": F.col("seq"), "forwarder-role": F.col("role")},
                        F.concat(F.lit("/network/forwarding-paths/forwarding-path/"), "evc", F.lit("/forwarders/forwarder/"), "seq"))
    fwd = cut(fwd, "fwd")
    n = fwd.count()
    take = lambda s: F.when(F.col("role") == INGRESS, F.col(f"collector_{s}")).when(
        F.col("role") == EGRESS, F.col(f"bearer_{s}"))
    middle = lambda s: F.when(F.col("seq") % 2 == 0, F.col(f"bearer_{s}")).otherwise(F.col(f"collector_{s}"))
    vlan = lambda s: F.nullif(F.coalesce(take(s), middle(s)), F.lit(""))
    plain = rows.select("cid", "role", "seq", "evc", *[f"{x}_{c}" for x in sides for c in ("circuit", "cvlan", "svlan")])
    conf_uri = F.concat(F.lit("/network/configurations/configuration/"), "cid")
    conf = cut(make_vertices(plain, ["evc", "seq"], base + n, "configuration", {
        "configuration-id": F.col("cid"), "configuration-type": F.lit("forwarder"), "configuration-sub-type": F.lit("forwarder")},
        conf_uri), "conf")
    fevc = cut(make_vertices(plain, ["evc", "seq"], base + 2 * n, "forwarder-evc", {
        "forwarder-evc-id": F.col("cid"), "circuit-id": take("circuit"), "cvlan": vlan("cvlan"), "svlan": vlan("svlan")},
        F.concat(conf_uri, F.lit("/forwarder-evcs/forwarder-evc/"), "cid")), "fevc")
    links = fwd.select("cid", "vid", "path_vid", "port_vid").join(conf.select("cid", F.col("vid").alias("conf_vid")), "cid").join(
        fevc.select("cid", F.col("vid").alias("fevc_vid")), "cid")
    v = g.v
    for made in (fwd, conf, fevc):
        v = v.unionByName(made.select(*g.v.columns))
    ports = links.join(g.v.select(F.col("vid").alias("port_vid"), F.col("node_type").alias("port_type")), "port_vid")
    e = g.e
    for made in (
        make_edges(links, "vid", "path_vid", labels.belongs_to, "IN", g.rules, ("forwarder", "forwarding-path")),
        make_edges(ports, "vid", "port_vid", labels.forwards_to, "NONE", g.rules, ("forwarder", F.col("port_type"))),
        make_edges(links, "vid", "conf_vid", labels.uses, "NONE", g.rules, ("forwarder", "configuration")),
        make_edges(links, "fevc_vid", "conf_vid", labels.belongs_to, "IN", g.rules, ("forwarder-evc", "configuration")),
    ):
        e = e.unionByName(made)
    return Outcome(v, e, links.select("vid"), bad)


def service_instances(g: Graph, feed: DataFrame, customer: str, service_type: str, labels: Labels = Labels()) -> Outcome:
    """Service-instance, forwarding-path, configuration and evc per feed row, each level only if absent.

    ``feed``: line, evc, per side pnf and port, esp_circuit, esp_name, collector_tag,
    bearer_tag, rate; the last four characters of the rate are its unit.
    """
    feed = feed.where("evc <> ''")
    ok = valid_ports(g, feed, ["collector", "bearer"])
    bad = fallout(feed.join(ok.select("line"), "line", "left_anti"), "line", "port or pnf does not exist")
    rows = ok.groupBy("evc").agg(F.min(F.struct(
        "line", "rate", "esp_circuit", "esp_name", "collector_tag", "bearer_tag")).alias("r")).select("evc", "r.*")
    sub = walk(g.v, g.e, pick(g.v, "customer", cid="global-customer-id").where(F.col("cid") == customer).select("vid"),
               [Step("in", labels.belongs_to, "service-subscription", (prop("service-type") == service_type,))])
    sub_vid = sub.agg(F.min("vid")).first()[0]
    if sub_vid is None:
        bad = bad.unionByName(fallout(ok, "line", "no subscription"))
        return Outcome(g.v, g.e, None, bad)
    rows = written(rows.withColumn("sub_vid", F.lit(sub_vid)), "services")
    base, v, e = next_vid(g.v), g.v, g.e
    length = F.length("rate")
    value = F.substring("rate", F.lit(1), length - RATE_UNIT_LENGTH)
    unit = F.substring("rate", length - RATE_UNIT_LENGTH + 1, F.lit(RATE_UNIT_LENGTH))

    def level(parent: DataFrame, have: DataFrame, node_type: str, props: dict, uri):
        """(evc, vid) of the existing or new vertex of a level, and the new vertices."""
        nonlocal base, v
        old = have.groupBy("evc").agg(F.min("vid").alias("vid"))
        new = cut(make_vertices(parent.join(old, "evc", "left_anti"), ["evc"], base, node_type, props, uri), "level")
        base += new.count()
        v = v.unionByName(new.select(*g.v.columns))
        return written(old.join(parent.select("evc"), "evc", "left_semi").unionByName(new.select("evc", "vid")), "level"), new

    evc = F.col("evc")
    there = walk(g.v, g.e, sub, [Step("in", labels.belongs_to, "service-instance")]).join(
        pick(g.v, "service-instance", evc="service-instance-id"), "vid")
    si, new = level(rows, there, "service-instance", {"service-instance-id": evc, "service-type": F.lit(service_type)},
                    F.concat(F.lit("/business/service-instances/service-instance/"), evc))
    e = e.unionByName(make_edges(
        new, "vid", "sub_vid", labels.belongs_to, "IN", g.rules, ("service-instance", "service-subscription")))

    def below(parent: DataFrame, step: Step, prop_name: str) -> DataFrame:
        same = parent.select("vid", evc.alias("want"))
        return walk(g.v, g.e, same, [step]).join(pick(g.v, step.node_type, evc=prop_name), "vid").where("evc = want")

    there = below(si, Step("in", labels.applies_to, "forwarding-path"), "forwarding-path-id")
    up = si.withColumnRenamed("vid", "up_vid")
    fp, new = level(rows.join(up, "evc"), there, "forwarding-path", {"forwarding-path-id": evc, "forwarding-path-name": evc},
                    F.concat(F.lit("/network/forwarding-paths/forwarding-path/"), evc))
    e = e.unionByName(make_edges(
        new, "vid", "up_vid", labels.applies_to, "NONE", g.rules, ("forwarding-path", "service-instance")))
    there = below(fp, Step("out", labels.uses, "configuration"), "configuration-id")
    up = fp.withColumnRenamed("vid", "up_vid")
    cf, new = level(rows.join(up, "evc"), there, "configuration", {
        "configuration-id": evc, "configuration-type": F.lit("forwarding-path"), "configuration-sub-type": F.lit("evc")},
        F.concat(F.lit("/network/configurations/configuration/"), evc))
    e = e.unionByName(make_edges(new, "up_vid", "vid", labels.uses, "NONE", g.rules, ("forwarding-path", "configuration")))
    there = below(cf, Step("in", labels.belongs_to, "evc"), "evc-id")
    up = cf.withColumnRenamed("vid", "up_vid")
    _, new = level(rows.join(up, "evc"), there, "evc", {
        "evc-id": evc, "forwarding-path-topology": F.lit(PATH_TOPOLOGY), "cir-value": value, "cir-units": unit,
        "esp-evc-circuit-id": F.col("esp_circuit"), "esp-evc-cir-value": value, "esp-evc-cir-units": unit,
        "esp-itu-code": F.col("esp_name"), "tagmode-access-ingress": F.col("collector_tag"),
        "tagmode-access-egress": F.col("bearer_tag")},
        F.concat(F.lit("/network/configurations/configuration/"), evc, F.lit("/evcs/evc/"), evc))
    e = e.unionByName(make_edges(new, "vid", "up_vid", labels.belongs_to, "IN", g.rules, ("evc", "configuration")))
    return Outcome(v, e, rows.select("evc"), bad)


def tunnel_bandwidth(g: Graph, host_service: str, tunnel_service: str, labels: Labels = Labels()) -> Outcome:
    """Links of the ports whose name ends in 10 or 11 take the tunnel's bandwidth of wan1 or wan2.

    The tunnel hangs below an allotted resource that an instance of ``host_service``
    uses and an instance of ``tunnel_service`` owns.
    """
    owner = g.v.where(F.col("node_type") == "service-subscription")
    owned = walk(g.v, g.e, owner.where(prop("service-type") == tunnel_service).select("vid"), [
        Step("in", labels.belongs_to, "service-instance"), Step("in", labels.belongs_to, "allotted-resource")]).distinct()
    used = walk(g.v, g.e, owner.where(prop("service-type") == host_service).select("vid"), [
        Step("in", labels.belongs_to, "service-instance")]).distinct()
    instance = walk(g.v, g.e, used.select("vid", F.col("vid").alias("instance")), [Step("out", labels.uses, "allotted-resource")])
    instance = instance.join(owned, "vid", "left_semi").select("instance", F.col("vid").alias("res"))
    tunnel = walk(g.v, g.e, instance.select("res", F.col("res").alias("vid")).distinct(),
                  [Step("in", labels.belongs_to, "tunnel-xconnect")]).groupBy("res").agg(F.min("vid").alias("vid"))
    digits = lambda n: F.nullif(F.regexp_replace(prop(n), "[^0-9]", ""), F.lit(""))
    rates = tunnel.join(g.v.where(F.col("node_type") == "tunnel-xconnect").select(
        "vid", *[digits(f"bandwidth-{d}-{w}").alias(f"{d}_{w}") for d in ("up", "down") for w in TUNNEL_PORTS.values()]), "vid")
    ports = walk(g.v, g.e, instance.select("res", F.col("instance").alias("vid")), [
        Step("out", labels.composed_of, "generic-vnf"), Step("out", labels.hosted_on, "vserver"),
        Step("out", labels.hosted_on, "pserver"), Step("in", labels.binds_to, "p-interface")])
    ports = ports.join(pick(g.v, "p-interface", name="interface-name"), "vid").withColumn(
        "tail", F.element_at(F.split("name", "/"), -1)).where(F.col("tail").isin(*TUNNEL_PORTS))
    links = walk(g.v, g.e, ports.select("res", "tail", "vid"), [Step("out", labels.links_to, "physical-link")])
    pair = F.lit(None)
    for tail, wan in TUNNEL_PORTS.items():
        pair = F.when(F.col("tail") == tail, F.struct(F.col(f"up_{wan}").alias("up"), F.col(f"down_{wan}").alias("down"))).otherwise(pair)
    rows = links.join(rates.drop("vid"), "res").withColumn("p", pair).where("p.up IS NOT NULL AND p.down IS NOT NULL")
    hit = rows.groupBy("vid").agg(F.max(F.struct(F.col("res"), F.col("p"))).alias("b")).select(
        "vid", F.col("b.p.up").cast("int").alias("up"), F.col("b.p.down").cast("int").alias("down"),
        F.lit(TUNNEL_UNITS).alias("units"))
    v = update_props(g.v, hit, {
        "service-provider-bandwidth-up-value": "up", "service-provider-bandwidth-up-units": "units",
        "service-provider-bandwidth-down-value": "down", "service-provider-bandwidth-down-units": "units"})
    return Outcome(v, g.e, hit.select("vid"))


def _forwarders_of_ports(g: Graph, ports: DataFrame, labels: Labels, conds: tuple = ()) -> DataFrame:
    """(pnf, port, kind, vid): forwarders at the distinct ports named by ``pnf``, ``port`` and ``kind``."""
    ends = None
    for kind in ("p-interface", "lag-interface"):
        asked = ports.where(F.col("kind") == kind).select("pnf", "port").distinct()
        boxes = pick(g.v, "pnf", pnf="pnf-name").join(asked.select("pnf").distinct(), "pnf", "left_semi")
        rows = walk(g.v, g.e, boxes, [Step("in", labels.binds_to, kind)])
        rows = rows.join(pick(g.v, kind, port="interface-name"), "vid").join(asked, ["pnf", "port"], "left_semi")
        rows = walk(g.v, g.e, rows, [Step("in", labels.forwards_to, "forwarder", conds)]).withColumn("kind", F.lit(kind))
        ends = rows if ends is None else ends.unionByName(rows)
    return ends


def circuit_ids(g: Graph, feed: DataFrame, labels: Labels = Labels()) -> Outcome:
    """The forwarder-evc behind a port's ingress forwarder of sequence 1 changes its circuit id
    from ``old`` to ``new`` (``line``, ``pnf``, ``port``, ``old``, ``new``).

    A line meets the forwarder-evcs of its port on the old circuit id as well, so
    a busy port does not multiply lines by forwarders.
    """
    feed = written(feed, "circuit_feed")
    kinds = F.explode(F.array(F.lit("p-interface"), F.lit("lag-interface"))).alias("kind")
    ends = _forwarders_of_ports(g, feed.select("pnf", "port", kinds), labels,
                                (prop("forwarder-role") == INGRESS, prop("sequence") == "1"))
    ends = walk(g.v, g.e, ends, [Step("out", labels.uses, "configuration"), Step("in", labels.belongs_to, "forwarder-evc")])
    ends = written(ends.join(pick(g.v, "forwarder-evc", have="circuit-id"), "vid"), "circuits")
    rows = written(feed.where((F.col("new") != "") & (F.col("new") != F.col("old"))).withColumnRenamed("old", "have").join(
        ends.select("pnf", "port", "have", "vid"), ["pnf", "port", "have"]), "circuits")
    hit = rows.groupBy("vid").agg(F.min_by("new", "line").alias("new"))
    at_port = ends.select("pnf", "port").distinct()
    bad = fallout(feed.join(at_port, ["pnf", "port"], "left_anti"), "line", "no forwarder-evc").unionByName(
        fallout(feed.join(at_port, ["pnf", "port"], "left_semi").join(rows.select("line"), "line", "left_anti"),
                "line", "circuit id does not match"))
    return Outcome(update_props(g.v, hit, {"circuit-id": "new"}), g.e, hit.select("vid"), bad)


def port_ivlans(g: Graph, feed: DataFrame, labels: Labels = Labels()) -> Outcome:
    """Forwarder-evcs of a port and evc take the feed's ivlan (``line``, ``evc``, ``pnf``, ``port``,
    ``ivlan``); a port with a dot is physical, else a lag."""
    kind = F.when(F.contains("port", F.lit(".")), "p-interface").otherwise("lag-interface")
    feed = written(feed.withColumn("kind", kind), "ivlan_feed")
    ends = _forwarders_of_ports(g, feed, labels).withColumn("fwd", F.col("vid"))
    ends = written(ends, "ivlan_forwarders")
    evcs = walk(g.v, g.e, ends.select("fwd", "vid").distinct(), [Step("out", labels.belongs_to, "forwarding-path")]).join(
        pick(g.v, "forwarding-path", evc="forwarding-path-id"), "vid").select("fwd", "evc").distinct()
    fevc = walk(g.v, g.e, ends.select("fwd", "vid").distinct(), [
        Step("out", labels.uses, "configuration"), Step("in", labels.belongs_to, "forwarder-evc")])
    last = feed.groupBy("pnf", "port", "evc").agg(F.max_by("ivlan", "line").alias("ivlan"), F.max("line").alias("line"))
    keyed = ends.select("pnf", "port", "fwd").join(evcs, "fwd").join(last, ["pnf", "port", "evc"]).join(fevc, "fwd")
    keyed = written(keyed, "ivlans")
    hit = keyed.groupBy("vid").agg(F.max_by("ivlan", "line").alias("ivlan"))
    boxes = pick(g.v, "pnf", pnf="pnf-name").select("pnf").distinct()
    met = keyed.select("pnf", "port", "evc").distinct()
    bad = fallout(feed.join(boxes, "pnf", "left_anti"), "line", "no pnf").unionByName(
        fallout(feed.join(boxes, "pnf", "left_semi").join(met, ["pnf", "port", "evc"], "left_anti"), "line", "no forwarder-evc"))
    return Outcome(update_props(g.v, hit, {"ivlan": "ivlan"}), g.e, hit.select("vid"), bad)


def upgrade_cycles(g: Graph, feed: DataFrame, owner: str) -> Outcome:
    """Regions of an owner take the upgrade cycle of their id, or of the row that has them as alias.

    ``feed``: line, region, alias, cycle; the first row of a region counts.
    """
    rows = feed.where("region <> ''").groupBy("region").agg(F.min_by(F.struct("alias", "cycle"), "line").alias("r")).select(
        "region", "r.*")
    mine = g.v.where((F.col("node_type") == "cloud-region") & (prop("cloud-owner") == owner)).select(
        "vid", prop("cloud-region-id").alias("rid"))
    direct = rows.join(mine, F.col("region") == F.col("rid"), "left")
    by_alias = direct.where("vid IS NULL").drop("vid", "rid").join(mine, F.col("alias") == F.col("rid"), "left")
    hits = direct.where("vid IS NOT NULL").select("region", "vid", "cycle", F.lit(0).alias("how")).unionByName(
        by_alias.select("region", "vid", "cycle", F.lit(1).alias("how")))
    hit = hits.where("vid IS NOT NULL AND cycle <> ''").groupBy("vid").agg(
        F.min_by("cycle", F.struct("how", "region")).alias("cycle"))
    bad = fallout(hits.where("vid IS NULL"), "region", "no such region")
    return Outcome(update_props(g.v, hit, {"upgrade-cycle": "cycle"}), g.e, hit.select("vid"), bad)


VLAN_DDL = """url STRING, `vlan-range` STRUCT<`vlan-range-id`: STRING, `vlan-id-lower`: BIGINT, `vlan-id-upper`: BIGINT,
 `vlan-type`: STRING, `vlan-tags`: STRUCT<`vlan-tag`: ARRAY<STRUCT<`vlan-tag-id`: STRING, `vlan-tag-role`: STRING,
 `is-private`: BOOLEAN, `vlan-id-inner`: BIGINT, `vlan-id-outer`: BIGINT, `vlan-tag-function`: STRING,
 `config-phase`: STRING, `vlan-tag-type`: STRING>>>>"""


def read_vlan_results(spark, path: str) -> DataFrame:
    """One result object per line of the query answer."""
    return spark.read.schema(VLAN_DDL).json(path)


def vlan_tags(g: Graph, results: DataFrame, labels: Labels = Labels()) -> Outcome:
    """Vlan tags outside a region move below a vlan range of the region in parts 6 and 7 of the URL.

    A range is made once it holds a known tag; a tag goes to the first range (by
    id) naming it; the edges of the old tag go over to the new one.
    """
    url = F.split("url", "/")
    r = F.col("`vlan-range`")
    rows = results.select(
        F.get(url, F.lit(6)).alias("owner"), F.get(url, F.lit(7)).alias("region"), r["vlan-range-id"].alias("range_id"),
        r["vlan-id-lower"].alias("lower"), r["vlan-id-upper"].alias("upper"), r["vlan-type"].alias("kind"),
        F.explode(r["vlan-tags"]["vlan-tag"]).alias("t"))
    regions = pick(g.v, "cloud-region", owner="cloud-owner", region="cloud-region-id").groupBy("owner", "region").agg(
        F.min("vid").alias("region_vid"))
    known = g.v.where((F.col("node_type") == "vlan-tag") & ~F.contains("uri", F.lit("cloud-region"))).groupBy(
        prop("vlan-tag-id").alias("tag_id")).agg(F.min("vid").alias("old_vid"))
    rows = rows.withColumn("tag_id", F.col("t.vlan-tag-id")).join(regions, ["owner", "region"]).join(known, "tag_id")
    rows = written(rows, "vlan_rows")
    first = rows.groupBy("tag_id").agg(F.min(F.struct("owner", "region", "range_id")).alias("k")).select("tag_id", "k.*")
    rows = rows.join(first, ["tag_id", "owner", "region", "range_id"], "left_semi").dropDuplicates(["tag_id"])
    rows = written(rows, "vlan_rows")

    base = next_vid(g.v)
    uri = F.concat(F.lit(REGION_URI), "owner", F.lit("/"), "region", F.lit("/vlan-ranges/vlan-range/"), "range_id")
    ranges = rows.groupBy("owner", "region", "range_id").agg(
        F.min("region_vid").alias("region_vid"), F.min("lower").alias("lower"), F.min("upper").alias("upper"), F.min("kind").alias("kind"))
    ranges = cut(make_vertices(ranges, ["owner", "region", "range_id"], base, "vlan-range", {
        "vlan-range-id": F.col("range_id"), "vlan-id-lower": F.col("lower"), "vlan-id-upper": F.col("upper"),
        "vlan-type": F.col("kind")}, uri), "vlan_ranges")
    names = ["vlan-tag-id", "vlan-tag-role", "is-private", "vlan-id-inner", "vlan-id-outer", "vlan-tag-function",
             "config-phase", "vlan-tag-type"]
    tags = rows.join(ranges.select("owner", "region", "range_id", F.col("vid").alias("range_vid"), F.col("uri").alias("range_uri")),
                     ["owner", "region", "range_id"])
    tags = tags.select("tag_id", "old_vid", "range_vid", "range_uri", *[F.col("t")[n].alias(n.replace("-", "_")) for n in names])
    tags = cut(make_vertices(tags, ["tag_id"], base + ranges.count(), "vlan-tag", {
        n: F.col(n.replace("-", "_")) for n in names}, F.concat("range_uri", F.lit("/vlan-tags/vlan-tag/"), "tag_id")), "vlan_tags")

    moved = tags.select(F.col("old_vid"), F.col("vid").alias("_new"))
    end = lambda s: moved.toDF(s, f"_{s}")
    e = g.e.join(end("src"), "src", "left").join(end("dst"), "dst", "left").select(*[
        F.coalesce("_src", "src").alias("src") if c == "src" else F.coalesce("_dst", "dst").alias("dst") if c == "dst"
        else F.col(c) for c in g.e.columns])
    v, e = delete_vertices(g.v, e, tags.select(F.col("old_vid").alias("vid")))
    v = v.unionByName(ranges.select(*g.v.columns)).unionByName(tags.select(*g.v.columns))
    e = e.unionByName(make_edges(
        ranges, "vid", "region_vid", labels.belongs_to, "IN", g.rules, ("vlan-range", "cloud-region"))).unionByName(
        make_edges(tags, "vid", "range_vid", labels.belongs_to, "IN", g.rules, ("vlan-tag", "vlan-range")))
    left = known.join(tags.select("tag_id"), "tag_id", "left_anti")
    return Outcome(v, e, tags.select("vid"), fallout(left, "tag_id", "not in the results"))
