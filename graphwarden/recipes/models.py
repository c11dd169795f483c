"""Recipes around models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.bounds import small
from graphwarden.functions.storage import cut, written
from graphwarden.model import Graph
from graphwarden.operators.migrate import Outcome, swing_edges
from graphwarden.operators.repair import delete_vertices
from graphwarden.recipes.common import Labels, Step, fallout, make_edges, pick, update_props, walk

# Types that carry local model ids, each with the property naming it.
MODEL_USERS = {
    "connector": "resource-instance-id", "service-instance": "service-instance-id", "configuration": "configuration-id",
    "logical-link": "link-name", "vnfc": "vnfc-name", "l3-network": "network-id", "generic-vnf": "vnf-id",
    "pnf": "pnf-name", "vf-module": "vf-module-id", "instance-group": "id", "allotted-resource": "id",
    "collection": "collection-id",
}
MODEL_VER_URI = "/service-design-and-creation/models/model/{inv}/model-vers/model-ver/{ver}"
SERVICE_MODEL, RESOURCE_MODEL = "service", "resource"


def link_model_versions(g: Graph, labels: Labels = Labels()) -> Outcome:
    """A private edge from every vertex with local model ids to the model-ver of that URI.

    An edge counts as present if a vertex of the same type and key has one.
    """
    p = F.col("props")
    key = F.lit(None).cast("string")
    for node_type, name in MODEL_USERS.items():
        key = F.when(F.col("node_type") == node_type, p.getItem(name)).otherwise(key)
    users = g.v.where(F.col("node_type").isin(*MODEL_USERS)).select(
        "vid", "node_type", key.alias("key"), p.getItem("model-invariant-id-local").alias("inv"),
        p.getItem("model-version-id-local").alias("ver")).where("inv IS NOT NULL AND ver IS NOT NULL")
    before, middle = MODEL_VER_URI.split("{inv}")[0], MODEL_VER_URI.split("{inv}")[1].split("{ver}")[0]
    users = users.withColumn("uri", F.concat(F.lit(before), "inv", F.lit(middle), "ver"))
    vers = g.v.where(F.col("node_type") == "model-ver").groupBy("uri").agg(F.min("vid").alias("ver_vid"))
    rows = users.join(vers, "uri", "left")
    there = g.e.where(F.col("label") == labels.is_a).select(F.col("src").alias("vid"), F.col("dst").alias("ver_vid")).join(
        users.select("vid", "node_type", "key"), "vid").select("node_type", "key", "ver_vid").distinct()
    new = rows.where("ver_vid IS NOT NULL").join(there, ["node_type", "key", "ver_vid"], "left_anti")
    made = make_edges(new, "vid", "ver_vid", labels.is_a, "NONE", g.rules, (F.col("node_type"), "model-ver"))
    return Outcome(g.v, g.e.unionByName(made), made.select("eid"),
                   fallout(rows.where("ver_vid IS NULL"), "uri", "no model-ver"))


def link_network_technologies(g: Graph, owners: dict[str, list[str]], labels: Labels = Labels()) -> Outcome:
    """Cousin edges from the regions of an owner to each technology of its list, if absent."""
    wanted = g.v.sparkSession.createDataFrame(
        [(o, t) for o, names in owners.items() for t in names], "owner string, tech string")
    regions = pick(g.v, "cloud-region", owner="cloud-owner")
    techs = pick(g.v, "network-technology", tech="network-technology-name").withColumnRenamed("vid", "tech_vid")
    pairs = regions.join(small(wanted), "owner").join(small(techs), "tech")
    there = g.e.select(F.col("src").alias("vid"), F.col("dst").alias("tech_vid"))
    made = make_edges(pairs.join(there, ["vid", "tech_vid"], "left_anti"), "vid", "tech_vid", labels.uses,
                      "NONE", g.rules, ("cloud-region", "network-technology"))
    return Outcome(g.v, g.e.unionByName(made), made.select("eid"))


def _widget_versions(g: Graph, labels: Labels) -> DataFrame:
    """(model, inv, vid = version, ver, name) of the widget models."""
    widgets = g.v.where((F.col("node_type") == "model") & (F.col("props").getItem("model-type") == "widget")).select(
        F.col("vid"), F.col("vid").alias("model"), F.col("props").getItem("model-invariant-id").alias("inv"))
    hop = walk(g.v, g.e, widgets, [Step("in", labels.belongs_to, "model-ver")])
    return hop.join(pick(g.v, "model-ver", ver="model-version-id", name="model-name"), "vid")


def _first(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.min_by(c, F.struct(*cols)).alias(c) for c in cols])


def swing_bad_models(g: Graph, valid: DataFrame, labels: Labels = Labels()) -> Outcome:
    """Named-query elements of a widget model that is not valid move to the valid model of its name.

    ``valid`` holds ``name``, ``version_id``, ``invariant_id``.
    """
    bad = _widget_versions(g, labels).join(valid.select(F.col("invariant_id").alias("inv")).distinct(), "inv", "left_anti")
    models = pick(g.v, "model", invariant_id="model-invariant-id").groupBy("invariant_id").agg(F.min("vid").alias("new"))
    to = _first(valid, "name", ["invariant_id"]).join(models, "invariant_id")
    pairs = bad.join(to, "name").groupBy(F.col("model").alias("old")).agg(F.min("new").alias("new"))
    e, moved = swing_edges(g.e, g.v, pairs, "named-query-element", labels.is_a, "IN")
    lost = bad.join(to.select("name"), "name", "left_anti")
    return Outcome(g.v, e, moved.select("eid"), fallout(lost, "name", "no valid model"))


def swing_bad_versions(g: Graph, valid: DataFrame, labels: Labels = Labels()) -> Outcome:
    """Edges of a widget version that is not the valid one of its name move to that; the old version
    goes if only its edge to its model is left and nothing but versions hangs on that model; the model
    follows if nothing holds it and it is not valid."""
    rows = _widget_versions(g, labels)
    good = _first(valid, "name", ["version_id"])
    target = pick(g.v, "model-ver", version_id="model-version-id").groupBy("version_id").agg(F.min("vid").alias("new"))
    pairs = cut(rows.join(good, "name").where("ver <> version_id").join(target, "version_id").select(
        F.col("vid").alias("old"), "new", F.col("model"), "inv"), "versions")
    e, moved = swing_edges(g.e, g.v, pairs, None, labels.is_a, "IN")
    e = written(e, "versions_e")

    old = pairs.select(F.col("old").alias("vid"), "model", "inv")
    has_in = e.select(F.col("dst").alias("vid"))
    outs = e.select(F.col("src").alias("vid"), "label", "dst").join(old.select("vid").distinct(), "vid", "left_semi")
    several = outs.groupBy("vid").agg(F.count("*").alias("n"), F.max(F.col("label") != labels.belongs_to).alias("other"))
    held = e.where(F.col("label") != labels.belongs_to).select(F.col("dst").alias("model"))
    gone = old.join(has_in, "vid", "left_anti").join(several.where("n = 1 AND NOT other"), "vid", "left_semi").join(
        held, "model", "left_anti")
    gone = cut(gone.distinct(), "versions_gone")
    v, e = delete_vertices(g.v, e, gone)
    e = written(e, "versions_e")
    parents = gone.join(valid.select(F.col("invariant_id").alias("inv")).distinct(), "inv", "left_anti").select(
        F.col("model").alias("vid")).distinct()
    busy = e.select(F.explode(F.array("src", "dst")).alias("vid"))
    free = parents.join(busy, "vid", "left_anti")
    v, e = delete_vertices(v, e, free)
    return Outcome(v, e, moved.select("eid").unionByName(gone.select(F.col("vid").cast("string").alias("eid"))))


def _point_to_version(g: Graph, e: DataFrame, rows: DataFrame, labels: Labels) -> DataFrame:
    """Edges after each row's ``vid`` gives up its model-ver edges for one to ``ver_vid``."""
    vers = g.v.where(F.col("node_type") == "model-ver").select(F.col("vid").alias("dst"))
    old = e.where(F.col("label") == labels.is_a).join(rows.select(F.col("vid").alias("src")).distinct(), "src", "left_semi").join(
        vers, "dst", "left_semi").select("eid")
    return e.join(old, "eid", "left_anti").select(*g.e.columns).unionByName(
        make_edges(rows.select("vid", "ver_vid").distinct().join(g.v.select("vid", "node_type"), "vid"), "vid", "ver_vid", labels.is_a,
                   "NONE", g.rules, (F.col("node_type"), "model-ver")))


def model_elements_below(g: Graph, starts: DataFrame, labels: Labels) -> DataFrame:
    """(start, name, inv, ver_vid, ver): versions used by the model elements below each start version.

    The nearest level that holds a name decides.
    """
    level = walk(g.v, g.e, starts.select("vid", F.col("vid").alias("start")).distinct(),
                 [Step("in", labels.belongs_to, "model-element")])
    level, seen, out, depth = cut(level.distinct(), "elements"), None, None, 0
    while not level.isEmpty():
        hits = walk(g.v, g.e, level.select("start", "vid"), [Step("out", labels.is_a, "model-ver")]).withColumn(
            "depth", F.lit(depth))
        out = hits if out is None else out.unionByName(hits)
        seen = level if seen is None else seen.unionByName(level)
        level = cut(walk(g.v, g.e, level, [Step("in", labels.belongs_to, "model-element")]).distinct().join(
            seen, ["start", "vid"], "left_anti"), "elements")
        depth += 1
    if out is None:
        out = level.withColumn("depth", F.lit(0))
    vers = pick(g.v, "model-ver", name="model-name", ver="model-version-id")
    inv = walk(g.v, g.e, vers.select("vid", F.col("vid").alias("ver_vid")), [Step("out", labels.belongs_to, "model")]).join(
        pick(g.v, "model", inv="model-invariant-id"), "vid").select("ver_vid", "inv")
    rows = out.withColumnRenamed("vid", "ver_vid").join(vers.withColumnRenamed("vid", "ver_vid"), "ver_vid").join(inv, "ver_vid")
    return rows.groupBy("start", "name").agg(F.min(F.struct("depth", "ver_vid", "ver", "inv")).alias("b")).select(
        "start", "name", "b.ver_vid", "b.ver", "b.inv")


def change_models(g: Graph, models: DataFrame, vnfs: DataFrame, labels: Labels = Labels()) -> Outcome:
    """VNFs of a type take its new resource model, their service instances its new service model,
    their vf-modules the version of the given name below the resource model, and the servers of
    those the named image.

    ``models``: model_type, vnf_type, inv, ver, customization, model_name, image (service and resource
    rows per vnf type; any other model_type is a vf-module id).  ``vnfs``: vnf_name, vnf_type.
    """
    kind = F.lower("model_type")
    last = lambda k: models.where(kind == k).groupBy("vnf_type").agg(
        F.max(F.struct("inv", "ver", "customization")).alias("m")).select("vnf_type", "m.*")
    inv_of = pick(g.v, "model", inv="model-invariant-id")
    known = walk(g.v, g.e, inv_of, [Step("in", labels.belongs_to, "model-ver")]).join(
        pick(g.v, "model-ver", ver="model-version-id", version="model-version"), "vid")
    known = known.groupBy("inv", "ver").agg(F.min("vid").alias("ver_vid"), F.min_by("version", "vid").alias("version"))
    known = written(known, "versions")

    box = pick(g.v, "generic-vnf", vnf_name="vnf-name", vnf_type="vnf-type")
    asked = vnfs.select("vnf_name", "vnf_type").distinct().join(
        models.select("vnf_type").where("vnf_type <> ''").distinct(), "vnf_type", "left_semi")
    hit = asked.join(last(RESOURCE_MODEL), "vnf_type", "left").join(known, ["inv", "ver"], "left")
    no_model = hit.where("ver_vid IS NULL")
    vnf = written(hit.where("ver_vid IS NOT NULL").join(box, ["vnf_name", "vnf_type"]), "vnfs")
    no_vnf = hit.where("ver_vid IS NOT NULL").join(box, ["vnf_name", "vnf_type"], "left_anti")
    ids = {"model-invariant-id-local": "inv", "model-version-id-local": "ver", "persona-model-version": "version"}
    v = update_props(g.v, vnf, {**ids, "model-customization-id": "customization"})
    e = _point_to_version(g, g.e, vnf, labels)

    service = walk(g.v, g.e, vnf.select("vid", "vnf_type"), [Step("in", labels.composed_of, "service-instance")]).distinct()
    service = service.join(last(SERVICE_MODEL), "vnf_type").join(known, ["inv", "ver"])
    service = written(service.groupBy("vid").agg(F.max(F.struct("inv", "ver", "version", "ver_vid")).alias("m")).select(
        "vid", "m.*"), "services")
    v = update_props(v, service, ids)
    e = _point_to_version(g, e, service, labels)

    wanted = models.where(~kind.isin(SERVICE_MODEL, RESOURCE_MODEL)).select(
        F.col("model_type").alias("module_id"), F.col("model_name").alias("name"), "image").distinct()
    module = walk(g.v, g.e, vnf.select("vid", F.col("ver_vid").alias("start")), [Step("in", labels.belongs_to, "vf-module")])
    module = module.join(pick(g.v, "vf-module", module_id="vf-module-id"), "vid").join(wanted, "module_id")
    below = model_elements_below(g, vnf.select(F.col("ver_vid").alias("vid")), labels)
    module = module.join(below, ["start", "name"], "left").join(
        known.select("ver_vid", "version"), "ver_vid", "left")
    no_version = module.where("ver_vid IS NULL")
    module = written(module.where("ver_vid IS NOT NULL"), "modules")
    one = module.groupBy("vid").agg(F.max(F.struct("inv", "ver", "version", "ver_vid")).alias("m")).select("vid", "m.*")
    v = update_props(v, one, ids)
    e = _point_to_version(g, e, one, labels)

    server = walk(g.v, g.e, module.select("vid", "image"), [Step("out", labels.uses, "vserver")]).select(
        F.col("vid").alias("server"), "vid", "image").distinct()
    at = walk(g.v, g.e, server, [Step("out", labels.belongs_to, "tenant"), Step("out", labels.belongs_to, "cloud-region")])
    regions = at.select("vid", F.col("vid").alias("region")).distinct()
    stock = walk(g.v, g.e, regions, [Step("in", labels.belongs_to, "image")]).join(
        pick(g.v, "image", image="image-name"), "vid").groupBy("region", "image").agg(F.min("vid").alias("image_vid"))
    image = at.withColumnRenamed("vid", "region").join(stock, ["region", "image"]).groupBy("server").agg(
        F.min("image_vid").alias("image_vid"))
    image = written(image, "images")
    images = g.v.where(F.col("node_type") == "image").select(F.col("vid").alias("dst"))
    old = e.where(F.col("label") == labels.uses).join(image.select(F.col("server").alias("src")), "src", "left_semi").join(
        images, "dst", "left_semi").select("eid")
    e = e.join(old, "eid", "left_anti").select(*g.e.columns).unionByName(make_edges(
        image, "server", "image_vid", labels.uses, "NONE", g.rules, ("vserver", "image")))
    bad = fallout(no_model, "vnf_name", "no resource model version").unionByName(
        fallout(no_vnf, "vnf_name", "no such vnf")).unionByName(fallout(no_version, "module_id", "no module model version"))
    changed = vnf.select("vid").unionByName(service.select("vid")).unionByName(one.select("vid")).distinct()
    return Outcome(v, e, changed, bad)
