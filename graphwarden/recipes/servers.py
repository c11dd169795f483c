"""Server de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.bounds import few
from graphwarden.functions.keys import prop
from graphwarden.functions.storage import cut, written
from graphwarden.model import Graph
from graphwarden.operators.migrate import Outcome, rebuild_uris, swing_edges
from graphwarden.operators.structure import tree
from graphwarden.recipes.common import Labels, first_token, pick, update_props, walk, Step
from graphwarden.recipes.values import canonical_link_name

INTERFACES = ("p-interface", "lag-interface")


def same_source_pairs(v: DataFrame, sources: list[str], by: str) -> DataFrame:
    """(old, new) among servers of the sources that share the first host token.

    ``by`` is ``version`` (token of the fqdn, greatest resource version stays) or
    ``length`` (token of the host name, longest host name stays); the lowest id
    wins a draw.  One aggregate per token instead of comparing all pairs.
    """
    host = prop("hostname")
    token = first_token(prop("fqdn") if by == "version" else host)
    rank = F.col("resource_version").try_cast("long") if by == "version" else F.length(host)
    mine = v.where((F.col("node_type") == "pserver") & F.col("source_of_truth").isin(*sources)).select(
        "vid", token.alias("token"), rank.cast("long").alias("rank")).where("token IS NOT NULL")
    best = mine.groupBy("token").agg(
        F.max_by("vid", F.struct(F.col("rank"), (-F.col("vid")))).alias("new"), F.count("*").alias("n")).where("n > 1")
    return mine.join(best.select("token", "new"), "token").where("vid <> new").select(F.col("vid").alias("old"), "new")


def matching_interfaces(v: DataFrame, e: DataFrame, pairs: DataFrame) -> DataFrame:
    """(old_if, new_if) of equal type and name below old and new servers; the lowest new id counts."""
    kids = tree(e).join(
        v.where(F.col("node_type").isin(*INTERFACES)).select(
            F.col("vid").alias("child_vid"), F.concat_ws("|", "node_type", prop("interface-name")).alias("name")),
        "child_vid").select("parent_vid", "child_vid", "name")
    new = kids.groupBy(F.col("parent_vid").alias("new"), "name").agg(F.min("child_vid").alias("new_if"))
    old = kids.select(F.col("parent_vid").alias("old"), "name", F.col("child_vid").alias("old_if"))
    return pairs.join(old, "old").join(new, ["new", "name"]).select("old_if", "new_if", "old", "new")


def merge_same_source(g: Graph, sources: list[str], by: str, labels: Labels = Labels()) -> Outcome:
    """Servers of one source that are the same host are merged into one.

    Interfaces of equal name hand their children and, where the other has none,
    their link to the kept one; the link is renamed after the kept host; all
    other edges swing; URIs below the kept server are rebuilt.
    """
    pairs = cut(same_source_pairs(g.v, sources, by), "server_pairs")
    match = cut(matching_interfaces(g.v, g.e, pairs), "interfaces")
    hosts = pick(g.v, "pserver", host="hostname")
    named = pairs.join(hosts.toDF("old", "old_host"), "old").join(hosts.toDF("new", "new_host"), "new")

    links = g.e.where(F.col("label") == labels.links_to)
    has_link = links.select(F.col("src").alias("new_if")).distinct()
    doomed = match.join(has_link, "new_if", "left_semi").join(
        links.select(F.col("src").alias("old_if"), F.col("dst").alias("vid")), "old_if").select("vid").distinct()

    # links of old interfaces that live on are renamed after the kept host
    old_links = walk(g.v, g.e, named.select(F.col("old").alias("vid"), "old_host", "new_host"), [
        Step("in", labels.binds_to, "p-interface"), Step("out", labels.links_to, "physical-link")])
    names = old_links.join(pick(g.v, "physical-link", name="link-name"), "vid").join(doomed, "vid", "left_anti")
    renamed = names.groupBy("vid").agg(F.min(canonical_link_name(F.replace(
        F.col("name"), F.col("old_host"), F.col("new_host")))).alias("name"))
    v = update_props(g.v, renamed.where(F.contains("name", F.lit("|"))), {"link-name": "name"})

    ends = match.select(F.col("old_if").alias("old"), F.col("new_if").alias("new"))
    near, rest = split_edges(g.e, pairs, ends, doomed.select(F.col("vid").alias("old"), F.col("vid").alias("new")))
    near = without(near, doomed)
    near, _ = swing_edges(near, v, ends, None, labels.links_to, "OUT")
    near, _ = swing_edges(near, v, ends, None, None, "IN")
    near = written(without(near, ends.select(F.col("old").alias("vid"))), "servers_e")
    near, _ = swing_edges(near, v, pairs)
    olds = pairs.select(F.col("old").alias("vid"))
    e = rest.unionByName(written(without(near, olds), "servers_e"))
    gone = few(doomed.unionByName(ends.select(F.col("old").alias("vid"))).unionByName(olds).distinct(), "servers_gone")
    v = v.join(gone, "vid", "left_anti")
    kept = pairs.select(F.col("new").alias("vid")).distinct()
    v, _ = rebuild_uris(v, e, g.nt, kept)
    return Outcome(v, e, kept)


def split_edges(e: DataFrame, *pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges at any vertex of the ``old``/``new`` pairs, as a written table; all others)."""
    ids = reduce(DataFrame.unionByName, [p.select(F.explode(F.array("old", "new")).alias("vid")) for p in pairs])
    ids = few(ids.distinct(), "servers_near")
    at = lambda s: ids.select(F.col("vid").alias(s))
    off = e.join(at("src"), "src", "left_anti")
    near = e.join(at("src"), "src", "left_semi").unionByName(off.join(at("dst"), "dst", "left_semi").select(*e.columns))
    return written(near.select(*e.columns), "servers_e"), off.join(at("dst"), "dst", "left_anti").select(*e.columns)


def without(e: DataFrame, vids: DataFrame) -> DataFrame:
    """Edges that touch none of the vertices."""
    return e.join(vids.select(F.col("vid").alias("src")), "src", "left_anti").join(
        vids.select(F.col("vid").alias("dst")), "dst", "left_anti").select(*e.columns)


def cross_source_pairs(v: DataFrame, kept: list[str], dropped: list[str]) -> DataFrame:
    """(old, new, first): each kept server matches the first dropped server whose host token equals its
    fqdn token; ``first`` marks the one kept server that takes the dropped one's edges."""
    server = v.where(F.col("node_type") == "pserver")
    left = server.where(F.col("source_of_truth").isin(*kept)).select(
        F.col("vid").alias("new"), first_token(prop("fqdn")).alias("token"))
    right = server.where(F.col("source_of_truth").isin(*dropped)).select(
        F.col("vid").alias("old"), first_token(prop("hostname")).alias("token"))
    match = right.where("token IS NOT NULL").groupBy("token").agg(F.min("old").alias("old"))
    pairs = left.join(match, "token")
    takers = pairs.groupBy("old").agg(F.min("new").alias("taker"))
    return pairs.join(takers, "old").select("old", "new", (F.col("new") == F.col("taker")).alias("first"))


def merge_cross_source(g: Graph, kept: list[str], dropped: list[str], labels: Labels = Labels()) -> Outcome:
    """Servers known to two sources become one: the kept one takes the other's host name as fqdn,
    the other's equal interfaces and location go, the rest swings over."""
    found = cut(cross_source_pairs(g.v, kept, dropped), "server_pairs")
    pairs = written(found.where("first").select("old", "new"), "server_pairs")
    match = matching_interfaces(g.v, g.e, pairs)
    hosts = pick(g.v, "pserver", host="hostname").toDF("old", "host")
    v = update_props(g.v, found.join(hosts, "old").select(F.col("new").alias("vid"), "host"), {"fqdn": "host"})
    no_id = g.v.where((F.col("node_type") == "pserver") & prop("pserver-id").isNull()).select("vid", F.md5(
        F.col("uri").cast("binary")).alias("id"))
    v = update_props(v, no_id.join(found.select(F.col("new").alias("vid")), "vid", "left_semi"), {"pserver-id": "id"})
    places = g.v.where(F.col("node_type") == "complex").select(F.col("vid").alias("dst"))
    located = g.e.where(F.col("label") == labels.located_in).join(places, "dst", "left_semi").join(
        pairs.select(F.col("old").alias("src")), "src", "left_semi").select("eid")
    ends = match.select(F.col("old_if").alias("old"), F.col("new_if").alias("new"))
    near, rest = split_edges(g.e, pairs, ends)
    near = near.join(located, "eid", "left_anti").select(*g.e.columns)
    near = written(without(near, ends.select(F.col("old").alias("vid"))), "servers_e")
    near, _ = swing_edges(near, v, pairs)
    olds = pairs.select(F.col("old").alias("vid"))
    e = rest.unionByName(written(without(near, olds), "servers_e"))
    gone = few(ends.select(F.col("old").alias("vid")).unionByName(olds).distinct(), "servers_gone")
    v = v.join(gone, "vid", "left_anti")
    kept_ids = found.select(F.col("new").alias("vid"))
    v, _ = rebuild_uris(v, e, g.nt, kept_ids)
    return Outcome(v, e, kept_ids)
