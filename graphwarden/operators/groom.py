"""Grooming: detection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from graphwarden.functions.bounds import one_row, small
from graphwarden.functions.keys import blank, has_keys
from graphwarden.functions.storage import cut
from graphwarden.operators import dupes
from graphwarden.operators.filters import window_start
from graphwarden.operators.structure import edge_detail, parent_counts, tree
from graphwarden.sources.bucketed import EndEdges, with_ends

# Finding kinds: fixed values.
GHOST, MISSING_TYPE, ORPHAN = "Phantom", "Missing Type", "Orphan"
BAD_EDGE, DUPLICATE, BAD_URI, BAD_KEY = "Bad Edge", "Duplicate", "Bad URI", "Bad Key"


def uri_owners(v: DataFrame, strict: bool = False) -> DataFrame:
    """(vid) of the vertex each URI leads to: the lowest id, or none if ``strict`` and shared."""
    owners = v.where(~blank(F.col("uri"))).groupBy("uri").agg(
        F.min("vid").alias("vid"), F.count("*").alias("_n"))
    if strict:
        owners = owners.where(F.col("_n") == 1)
    return owners.select("vid")


def vertex_checks(
    v: DataFrame, e: DataFrame | None, nt: DataFrame, strict_uri: bool = False, counts: DataFrame | None = None,
    texts: bool = True,
) -> DataFrame:
    """One row per vertex of a known type: parents, key and URI verdicts.

    ``counts`` gives (vid, n_parents) where they are known; edges are not read then.  Without ``texts`` the URI is left out
    and the uuid is null unless it is a marker: two thirds of what a row takes, which no verdict needs.

    The URI owner and the parent count are both joined on ``vid``, which is
    unique, so neither join meets a hot key.
    """
    types = small(nt).select("node_type", "keys", F.size("dependent_on").alias("_n_dep"))
    base = v.join(types, "node_type").select(
        "vid", "node_type", *(["uri"] if texts else []), "uuid" if texts else F.when(is_marker(), F.col("uuid")).alias("uuid"), "last_mod_ts",
        (F.col("_n_dep") > 0).alias("dependent"), has_keys(F.col("keys"), F.col("props")).alias("has_keys"))
    owners = uri_owners(v, strict_uri).withColumn("_ok", F.lit(True))
    out = base.join(parent_counts(e) if counts is None else counts, "vid", "left").join(owners, "vid", "left")
    n_parents = F.coalesce("n_parents", F.lit(0)).cast("long")
    return out.select(
        *base.columns,
        n_parents.alias("n_parents"),
        F.coalesce("_ok", F.lit(False)).alias("uri_ok"),
        # no verdict on the keys of a dependent without exactly one parent
        (~F.col("has_keys") & (~F.col("dependent") | (n_parents == 1))).alias("key_bad"),
    )


def is_marker() -> Column:
    """A vertex that an earlier repair filled with dummy values."""
    return F.coalesce(F.col("uuid") == F.concat(F.col("vid").cast("string"), F.lit("dummy")), F.lit(False))


def is_orphan() -> Column:
    return F.col("dependent") & (F.col("n_parents") == 0) & ~is_marker()


def is_ghost() -> Column:
    return F.col("key_bad") & ~F.col("uri_ok")


def find_orphans(v, e, nt):
    """G1: dependents without a parent.  Needs the tree only."""
    types = small(nt).where(F.size("dependent_on") > 0).select("node_type")
    kids = tree(e).select(F.col("child_vid").alias("vid"))
    return v.join(types, "node_type", "left_semi").join(kids, "vid", "left_anti").where(
        ~is_marker()).select("vid", "node_type")


def find_missing_type(v, e, nt):
    """Vertices without a type, and parentless dependents carrying the dummy mark."""
    types = small(nt).where(F.size("dependent_on") > 0).select("node_type")
    kids = tree(e).select(F.col("child_vid").alias("vid"))
    marked = v.where(is_marker()).join(types, "node_type", "left_semi").join(kids, "vid", "left_anti")
    return v.where(blank(F.col("node_type"))).select("vid").unionByName(marked.select("vid"))


def find_bad_uri(v, e, nt):
    """Keys fine, URI does not lead back to the vertex."""
    return vertex_checks(v, e, nt).where(~F.col("key_bad") & ~F.col("uri_ok")).select("vid", "node_type", "uri")


def find_bad_key(v, e, nt):
    """URI fine, keys missing."""
    return vertex_checks(v, e, nt).where(F.col("key_bad") & F.col("uri_ok")).select("vid", "node_type")


def find_ghosts(v, e, nt):
    """Neither keys nor URI lead to the vertex."""
    return vertex_checks(v, e, nt).where(is_ghost()).select("vid", "node_type")


def _suspect_edges(status: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((eid, src, dst) of the edges with an end that is absent or whose ``state`` is not ok, (vid) of all their ends)."""
    ends = e.select(F.explode(F.array("src", "dst")).alias("vid")).where("vid IS NOT NULL").distinct()
    faulty = status.where("state <> 'ok'").select("vid")
    # a written table of known size: Spark broadcasts it where it is small enough
    suspects = cut(ends.join(status.select("vid"), "vid", "left_anti").unionByName(faulty).distinct(), "suspects")
    edges = e.select("eid", "src", "dst")
    for side in ("src", "dst"):
        edges = edges.join(suspects.select(F.col("vid").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    hit = F.coalesce("_src", F.lit(False)) | F.coalesce("_dst", F.lit(False)) | F.col("src").isNull() | F.col("dst").isNull()
    edges = cut(edges.where(hit).select("eid", "src", "dst"), "suspect_edges")
    return edges, cut(edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct(), "suspect_ends")


def bad_edges_from(v: DataFrame, e: DataFrame | EndEdges, nt: DataFrame, checks: DataFrame, start: int = 0) -> DataFrame:
    """G6 on given checks: (eid, bad_vid, side, reason).

    Only edges with a suspect end (absent or not in order) meet the verdicts on both of their ends: of the others, the
    distinct ends alone are shuffled.
    """
    known = small(nt).select("node_type", "keys")
    status = v.join(known, "node_type", "left").select(
        "vid",
        F.when(blank(F.col("node_type")), "untyped")
        .when(F.col("keys").isNotNull() & (~has_keys(F.col("keys"), F.col("props")) | blank(F.col("uri"))), "missing_keys")
        .otherwise("ok").alias("state"))
    in_window = F.col("last_mod_ts").isNull() | (F.col("last_mod_ts") >= start)
    reach = checks.where(~is_ghost() & in_window).select("vid", F.lit(True).alias("reach"))
    if not isinstance(e, EndEdges):
        e, ids = _suspect_edges(status, e)
        status, reach = status.join(ids, "vid", "left_semi"), reach.join(ids, "vid", "left_semi")
    status = status.join(reach, "vid", "left")

    def end(side: str) -> DataFrame:
        return status.select(F.col("vid").alias(side), F.col("state").alias(f"{side}_state"),
                             F.col("reach").alias(f"{side}_reach"))

    ids = lambda d: d.select("eid", "src", "dst")
    both = with_ends(e.map(ids) if isinstance(e, EndEdges) else ids(e), end("src"), end("dst"), "left")
    both = both.where(F.coalesce("src_reach", F.lit(False)) | F.coalesce("dst_reach", F.lit(False)))
    ends = F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(s).alias("bad_vid"),
                 F.coalesce(f"{s}_state", F.lit("absent")).alias("reason")) for s in ("src", "dst")])
    return both.select("eid", F.explode(F.filter(ends, lambda x: x["reason"] != "ok")).alias("x")).select(
        "eid", "x.bad_vid", "x.side", "x.reason")


def find_bad_edges(v, e, nt, now_ms: int = 0, minutes: int = 0):
    """Edges whose end is absent, untyped, or lacks a key or its URI."""
    checks = vertex_checks(v, e, nt)
    return bad_edges_from(v, e, nt, checks, window_start(now_ms, minutes))


def find_dangling_ends(v, e):
    """Edge ends whose vertex cannot be fetched."""
    ids = v.select("vid")
    src = e.select("eid", F.lit("src").alias("side"), F.col("src").alias("vid"))
    dst = e.select("eid", F.lit("dst").alias("side"), F.col("dst").alias("vid"))
    return src.unionByName(dst).join(ids, "vid", "left_anti").select(
        "eid", "side", F.col("vid").alias("bad_vid"))


def find_multi_parent(v, e, nt):
    """Dependents with more than one parent."""
    types = small(nt).where(F.size("dependent_on") > 0).select("node_type")
    many = parent_counts(e).where(F.col("n_parents") > 1)
    return v.join(types, "node_type", "left_semi").join(many, "vid").select("vid", "node_type", "n_parents")


@dataclass(frozen=True)
class Findings:
    """Result of one grooming pass; every frame reads written tables."""

    checks: DataFrame
    missing_type: DataFrame
    bad_edges: DataFrame
    dupes: DataFrame
    minutes: int
    start: int

    def _in_window(self) -> DataFrame:
        return self.checks.where(F.col("last_mod_ts").isNull() | (F.col("last_mod_ts") >= self.start))


def groom(v, e, nt, now_ms: int = 0, minutes: int = 0) -> Findings:
    """One detection pass over the whole graph."""
    start = window_start(now_ms, minutes)
    checks = cut(vertex_checks(v, e, nt, texts=False), "checks", compression="zstd")
    groups = cut(dupes.find_dupe_groups(v, e, nt), "groups", compression="zstd")
    keepers = dupes.choose_keeper(groups, v, e, nt, owners=checks.where("uri_ok").select("vid"))
    return Findings(
        checks,
        find_missing_type(v, e, nt),
        cut(bad_edges_from(v, e, nt, checks, start), "bad_edges"),
        cut(dupes.with_keeper(groups, keepers), "dupes"),
        minutes, start,
    )


def groom_summary(f: Findings) -> DataFrame:
    """One row of counts per finding kind."""
    c = F.col
    nodes = f._in_window().agg(
        F.count("*").alias("nodes_seen"),
        F.count_if(is_ghost()).alias("ghosts"),
        F.count_if(is_orphan()).alias("orphans"),
        F.count_if(~c("key_bad") & ~c("uri_ok")).alias("bad_uris"),
        F.count_if(c("key_bad") & c("uri_ok")).alias("bad_keys"),
        F.count_if(c("dependent") & (c("n_parents") > 1)).alias("multi_parents"),
    )
    missing = f.missing_type.agg(F.count("*").alias("missing_types"))
    edges = f.bad_edges.agg(F.count_distinct("eid").alias("bad_edges"))
    is_first = c("vid") == c("group_id")
    groups = f.dupes.agg(
        F.count_if(is_first).alias("dupe_groups"),
        F.count_if(is_first & c("keeper_vid").isNotNull()).alias("dupe_groups_with_keeper"))
    row = one_row(nodes, missing, edges, groups)
    return row.withColumn("run_type", F.lit("PARTIAL" if f.minutes else "FULL"))


def delete_candidates(f: Findings) -> DataFrame:
    """(kind, id) for everything a repair run may delete."""
    def of(kind: str, df: DataFrame, col: str = "vid") -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("id"))

    seen = f._in_window()
    losers = f.dupes.where(F.col("keeper_vid").isNotNull() & (F.col("vid") != F.col("keeper_vid")))
    frames = [
        of(GHOST, seen.where(is_ghost())),
        of(MISSING_TYPE, f.missing_type),
        of(ORPHAN, seen.where(is_orphan())),
        of(BAD_EDGE, f.bad_edges.select("eid").distinct(), "eid"),
        of(DUPLICATE, losers.select("vid").distinct()),
    ]
    return reduce(DataFrame.unionByName, frames)


def groom_detail(findings: DataFrame, v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(properties, edges) of each found vertex; ``findings`` has ``kind`` and ``vid``."""
    ids = findings.select("kind", "vid")
    props = ids.join(v.select("vid", "node_type", "uri", "props"), "vid").select(
        "kind", "vid", "node_type", "uri", F.explode_outer("props").alias("key", "value"))
    edges = ids.join(edge_detail(v, e, ids), "vid")
    return props, edges


def latest_summary(runs: DataFrame) -> DataFrame:
    """The rows of the newest run; FULL before PARTIAL at the same time.

    ``runs`` holds ``run_ts`` and ``run_type`` besides the counts.
    """
    best = runs.agg(F.max(F.struct("run_ts", (F.col("run_type") == "FULL").alias("full"))).alias("b"))
    best = best.select(F.col("b.run_ts").alias("run_ts"),
                       F.when(F.col("b.full"), "FULL").otherwise("PARTIAL").alias("run_type"))
    return runs.join(F.broadcast(best), ["run_ts", "run_type"], "left_semi")
