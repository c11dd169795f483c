"""Joins over structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.storage import cut
from graphwarden.sources.bucketed import BucketedGraph

MAX_DEPTH = 15  # fixed value: deepest level of a descendant count


def tree(e: DataFrame) -> DataFrame:
    """(parent_vid, child_vid, eid); OUT names the source as the container, IN the target."""
    out = F.col("contains_other_v") == "OUT"
    return e.where(F.col("contains_other_v").isin("OUT", "IN")).select(
        F.when(out, F.col("src")).otherwise(F.col("dst")).alias("parent_vid"),
        F.when(out, F.col("dst")).otherwise(F.col("src")).alias("child_vid"),
        "eid",
    )


def parent_counts(e: DataFrame) -> DataFrame:
    return tree(e).groupBy(F.col("child_vid").alias("vid")).agg(F.count("*").alias("n_parents"))


def parents(v: DataFrame, e: DataFrame) -> DataFrame:
    """Every vertex with its parent count and its lowest and highest parent."""
    per_child = tree(e).groupBy(F.col("child_vid").alias("vid")).agg(
        F.count("*").alias("n_parents"),
        F.min("parent_vid").alias("first_parent"),
        F.max("parent_vid").alias("last_parent"),
    )
    return v.select("vid", "node_type").join(per_child, "vid", "left").withColumn(
        "n_parents", F.coalesce("n_parents", F.lit(0)).cast("long"))


def bucketed_parents(g: BucketedGraph) -> DataFrame:
    """J2 without an exchange: children are counted where their edges lie, and meet the vertices there."""
    out = g.v.select("vid", "node_type")
    names, sides = [], (("o", g.into, "src", "OUT"), ("i", g.out, "dst", "IN"))
    for name, edges, parent, contains in sides:
        aggregates = F.count("*").alias("n"), F.min(parent).alias("low"), F.max(parent).alias("high")
        rest, hubs = edges.per_end(*aggregates, where=F.col("contains_other_v") == contains)
        for part, counts in ((f"{name}r", rest), (f"{name}h", F.broadcast(hubs))):
            out = out.join(counts.toDF("vid", *[f"_{part}_{c}" for c in ("n", "low", "high")]), "vid", "left")
            names.append(part)
    of = lambda c: [F.col(f"_{n}_{c}") for n in names]
    n_parents = sum((F.coalesce(c, F.lit(0)) for c in of("n")), F.lit(0))
    return out.select("vid", "node_type", n_parents.cast("long").alias("n_parents"),
                      F.least(*of("low")).alias("first_parent"), F.greatest(*of("high")).alias("last_parent"))


def bucketed_neighbours(g: BucketedGraph) -> DataFrame:
    """J4 per vertex without an exchange: (vid, n, low, high), the number of edge ends and the lowest and highest neighbour."""
    out, names = g.v.select("vid"), []
    for name, edges, far in (("o", g.out, "dst"), ("i", g.into, "src")):
        rest, hubs = edges.per_end(F.count("*").alias("n"), F.min(far).alias("low"), F.max(far).alias("high"))
        for part, counts in ((f"{name}r", rest), (f"{name}h", F.broadcast(hubs))):
            out = out.join(counts.toDF("vid", *[f"_{part}_{c}" for c in ("n", "low", "high")]), "vid", "left")
            names.append(part)
    of = lambda c: [F.col(f"_{n}_{c}") for n in names]
    n = sum((F.coalesce(c, F.lit(0)) for c in of("n")), F.lit(0)).cast("long")
    return out.select("vid", n.alias("n"), F.least(*of("low")).alias("low"), F.greatest(*of("high")).alias("high")).where("n > 0")


def children(v: DataFrame, e: DataFrame, node_type: str) -> DataFrame:
    """(parent_vid, child columns) for children of one type."""
    kids = v.where(F.col("node_type") == node_type)
    return tree(e).join(kids, F.col("child_vid") == F.col("vid")).drop("child_vid", "eid")


def neighbours(e: DataFrame) -> DataFrame:
    """(vid, other_vid, eid, dir, label, contains_other_v), one row per edge end."""
    keep = ["eid", "label", "contains_other_v"]
    out = e.select(F.col("src").alias("vid"), F.col("dst").alias("other_vid"),
                   F.lit("OUT").alias("dir"), *keep)
    back = e.select(F.col("dst").alias("vid"), F.col("src").alias("other_vid"),
                    F.lit("IN").alias("dir"), *keep)
    return out.unionByName(back)


def is_cousin():
    return ~F.coalesce(F.col("contains_other_v"), F.lit("NONE")).isin("OUT", "IN")


def cousins(v: DataFrame, e: DataFrame) -> DataFrame:
    """Neighbours over edges that contain nothing, with the neighbour's type."""
    far = v.select(F.col("vid").alias("other_vid"), F.col("node_type").alias("other_type"))
    return neighbours(e.where(is_cousin())).join(far, "other_vid")


def ancestors(v: DataFrame, e: DataFrame) -> DataFrame:
    """(vid, depth, ancestor_vid), depth 1 being the parent; each ancestor once, at its least depth.

    Each round doubles the reach: an ancestor at up to twice the present reach is an ancestor of the one exactly at that
    reach, so a chain of depth d takes about log2(d) rounds.  The walk ends where no new ancestor is found, at any depth
    and also in a cycle.
    """
    up = tree(e).where("parent_vid <> child_vid").select(
        F.col("child_vid").alias("vid"), F.col("parent_vid").alias("ancestor_vid"), F.lit(1).alias("depth")).distinct()
    found, reach = cut(up, "ancestors"), 1
    while True:
        step = found.where(F.col("depth") == reach).select("vid", F.col("ancestor_vid").alias("_mid"))
        beyond = found.select(F.col("vid").alias("_mid"), "ancestor_vid", "depth")
        far = step.join(beyond, "_mid").where("vid <> ancestor_vid").groupBy("vid", "ancestor_vid").agg(
            (F.min("depth") + reach).alias("depth"))
        far = cut(far.join(found.select("vid", "ancestor_vid"), ["vid", "ancestor_vid"], "left_anti"), "ancestors")
        if far.isEmpty():
            return found.join(v.select("vid").distinct(), "vid", "left_semi")
        found, reach = found.unionByName(far), 2 * reach


def below(e: DataFrame, vids: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(parent_vid, child_vid) of the containment edges at and under the given vertices, each edge once per row of ``e``."""
    down = tree(e).select("parent_vid", "child_vid")
    seen = level = cut(vids.select("vid").distinct(), "below")
    depth = 1
    while max_depth is None or depth < max_depth:
        nxt = level.join(down, F.col("vid") == F.col("parent_vid")).select(F.col("child_vid").alias("vid")).distinct()
        level = cut(nxt.join(seen, "vid", "left_anti"), "below")
        if level.isEmpty():
            break
        seen, depth = seen.unionByName(level), depth + 1
    return down.join(seen, F.col("parent_vid") == F.col("vid"), "left_semi")


def count_descendants(e: DataFrame, vids: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(vid, n_descendants) = walks of length 1..max_depth down the tree.

    Counted from the leaves up: the walks of at most k steps from a vertex are, for each child, the step to it and its
    walks of at most k - 1 steps.  A round holds one number per vertex, whatever the number of roots.
    """
    roots = vids.select("vid").distinct()
    down = cut(below(e, roots, max_depth), "down")
    counts, total = None, None
    for _ in range(max_depth):
        step = F.lit(1).cast("decimal(38,0)")
        rows = down if counts is None else down.join(counts, "child_vid", "left")
        if counts is not None:
            step = F.lit(1) + F.coalesce("_n", F.lit(0).cast("decimal(38,0)"))
        counts = cut(rows.groupBy("parent_vid").agg(F.sum(step).cast("decimal(38,0)").alias("_n")).select(
            F.col("parent_vid").alias("child_vid"), "_n"), "walks")
        now = counts.agg(F.sum("_n")).first()[0]
        if now is None or now == total:  # counts never fall, so an equal sum means that none has changed
            break
        total = now
    return roots.join(counts.select(F.col("child_vid").alias("vid"), "_n"), "vid", "left").select(
        "vid", F.coalesce("_n", F.lit(0)).cast("long").alias("n_descendants"))


def count_edges(e: DataFrame, vids: DataFrame) -> DataFrame:
    """(vid, n_edges); a self-loop counts twice."""
    degree = neighbours(e).groupBy("vid").agg(F.count("*").alias("n_edges"))
    return vids.select("vid").distinct().join(degree, "vid", "left").withColumn(
        "n_edges", F.coalesce("n_edges", F.lit(0)).cast("long"))


def has_edge(pairs: DataFrame, e: DataFrame, direction: str = "BOTH", label: str | None = None) -> DataFrame:
    """The (a, b) pairs joined by an edge; OUT means a is the source."""
    if label is not None:
        e = e.where(F.col("label") == label)
    out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    found = {"OUT": out, "IN": back, "BOTH": out.unionByName(back)}[direction]
    return pairs.join(found, ["a", "b"], "left_semi")


def edge_detail(v: DataFrame, e: DataFrame, vids: DataFrame | None = None) -> DataFrame:
    """Per edge end: direction, label, other type and other id.

    ``other_type`` is null when the other end is absent or untyped.
    """
    ends = neighbours(e)
    if vids is not None:
        ends = ends.join(vids.select("vid").distinct(), "vid", "left_semi")
    far = v.select(F.col("vid").alias("other_vid"), F.col("node_type").alias("other_type"),
                   F.lit(True).alias("other_found"))
    return ends.join(far, "other_vid", "left").select(
        "vid", "dir", "label", "contains_other_v", "other_vid", "other_type",
        F.coalesce("other_found", F.lit(False)).alias("other_found"), "eid")


def _no_uri():
    return F.col("uri").isNull() | (F.col("uri") == "")


def edge_report(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report rows, vertices without a proper URI).

    A vertex without a URI is named by its id and type.
    """
    name = F.when(_no_uri(), F.concat_ws("-", F.col("vid").cast("string"), F.col("node_type"))
                  ).otherwise(F.col("uri"))
    names = v.select("vid", name.alias("_name"))
    src = names.select(F.col("vid").alias("src"), F.col("_name").alias("out_name"))
    dst = names.select(F.col("vid").alias("dst"), F.col("_name").alias("in_name"))
    rows = e.join(src, "src").join(dst, "dst").select(
        "eid",
        F.concat_ws("|", "out_name", "label", "in_name", "contains_other_v").alias("line"))
    return rows, v.where(_no_uri()).select("vid", "node_type")
