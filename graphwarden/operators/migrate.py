"""Generic migrations."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphwarden.functions.bounds import few, one_row, small
from graphwarden.functions.components import components
from graphwarden.functions.keys import blank, drop_prop, empty_props, key_str, prop, set_prop, url_encode
from graphwarden.functions.storage import cut, written
from graphwarden.functions.versions import VersionedStore
from graphwarden.model import Graph
from graphwarden.operators.structure import is_cousin, neighbours, tree
from graphwarden.sources.bucketed import EndEdges, with_ends

#: columns by which the written tables of a graph are partitioned
PARTITIONED = {"vertices": "node_type", "edges": "label"}
TREE, COUSIN = "tree", "cousin"
SUCCESS, FAILURE, CHECK_LOGS = "SUCCESS", "FAILURE", "CHECK_LOGS"


# ---------------------------------------------------------------- properties

def fill_values(
    v: DataFrame, spec: dict[str, dict[str, str]], conditions: dict[str, list[str]] | None = None,
    update_existing: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """M1: (vertices, changes).  Sets the listed values where absent or empty, or always with
    ``update_existing``; with ``conditions`` only where any of the named properties has a listed value."""
    allowed = F.lit(True)
    if conditions is not None:
        allowed = reduce(lambda a, b: a | b, [
            F.coalesce(prop(k).isin(*vals), F.lit(False)) for k, vals in conditions.items()], F.lit(False))
    names = list(dict.fromkeys(p for values in spec.values() for p in values))
    todo = {}
    for name in names:
        value = F.lit(None).cast("string")
        for node_type, values in spec.items():
            if name in values:
                value = F.when(F.col("node_type") == node_type, values[name]).otherwise(value)
        due = F.lit(True) if update_existing else blank(prop(name))
        todo[name] = F.when(allowed & due, value)
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in todo.items()]),
                       lambda x: x["value"].isNotNull())
    marked = v.where(F.col("node_type").isin(*spec)).withColumn("_set", entries)
    changes = marked.select("vid", "node_type", F.explode("_set").alias("x")).select(
        "vid", "node_type", "x.key", "x.value")
    keys = F.transform(entries, lambda x: x["key"])
    new = F.map_concat(F.map_filter(F.coalesce("props", empty_props()), lambda k, _: ~F.array_contains(keys, k)),
                       F.map_from_entries(entries))
    out = v.withColumn("props", F.when(F.col("node_type").isin(*spec), new).otherwise(F.col("props")))
    return out, changes


def rename_property(
    v: DataFrame, old: str, new: str, types: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """M2: (vertices, changed ids)."""
    mine = prop(old).isNotNull()
    if types:
        mine = F.coalesce(F.col("node_type").isin(*types), F.lit(False)) & mine
    moved = set_prop(drop_prop(F.col("props"), old), new, prop(old))
    return v.withColumn("props", F.when(mine, moved).otherwise(F.col("props"))), v.where(mine).select("vid")


def touch(v: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    """Bump last-modified and version of the changed vertices."""
    hit = few(ids.select("vid").distinct(), "touched").withColumn("_hit", F.lit(True))
    out = v.join(hit, "vid", "left")
    return out.select(*[
        F.when(F.col("_hit"), F.lit(now_ms).cast("long")).otherwise(F.col(c)).alias(c) if c == "last_mod_ts"
        else F.when(F.col("_hit"), F.lit(str(now_ms))).otherwise(F.col(c)).alias(c) if c == "resource_version"
        else F.col(c) for c in v.columns])


# ---------------------------------------------------------------- edges

def with_types(e: DataFrame | EndEdges, v: DataFrame, types: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Edges with the node types of both ends as ``src_type`` and ``dst_type``."""
    ids = v.select("vid", "node_type")
    if types:
        ids = ids.where(F.col("node_type").isin(*types))
    return with_ends(e, ids.toDF("src", "src_type"), ids.toDF("dst", "dst_type"), how)


def _pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def reset_edge_props(
    e: DataFrame, v: DataFrame, pairs: list[tuple[str, str]], rules: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """M3: (edges, edges of the pairs whose label no rule knows; those stay as they are)."""
    types = sorted({t for p in pairs for t in p})
    keys = sorted({"|".join(sorted(p)) for p in pairs})
    mine = with_types(e.select("eid", "src", "dst", "label"), v, types).withColumn(
        "_k", _pair_key(F.col("src_type"), F.col("dst_type"))).where(F.col("_k").isin(*keys))
    rule = small(rules.groupBy(_pair_key(F.col("from_type"), F.col("to_type")).alias("_k"), "label").agg(
        F.min(F.struct("contains_other_v", "delete_other_v", "prevent_delete")).alias("_r")))
    hit = mine.join(rule, ["_k", "label"], "left").select("eid", "_r")
    unknown = hit.where("_r IS NULL").select("eid")
    out = e.join(hit.where("_r IS NOT NULL"), "eid", "left")
    over = {"contains_other_v", "delete_other_v", "prevent_delete"}
    return out.select(*[
        F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in over
        else F.when(F.col("_r").isNotNull(), empty_props()).otherwise(F.col(c)).alias(c) if c == "props"
        else F.col(c) for c in e.columns]), unknown


def _keep_first(rows: DataFrame, key: list[str], side: str) -> DataFrame:
    """Rows that are the first edge (by id) of their constrained end; the others violate the multiplicity."""
    bound = F.col("multiplicity").isin(*({"src": ("MANY2ONE", "ONE2ONE"), "dst": ("ONE2MANY", "ONE2ONE")}[side]))
    first = rows.where(bound).groupBy(*key).agg(F.min("eid").alias("eid")).select("eid")
    return rows.where(~bound).unionByName(rows.where(bound).join(first, "eid", "left_semi").select(*rows.columns))


def rebuild_edges(
    e: DataFrame | EndEdges, v: DataFrame, rules: DataFrame, label_map: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """M4: (edges, report).  Every edge is made anew from the rule of its type pair.

    With several rules the label decides, first through ``label_map``.  The
    report has a row per edge that was skipped (an end or a rule is missing) or
    that breaks the multiplicity of its rule.
    """
    label = F.col("label")
    for old, new in (label_map or {}).items():
        label = F.when(F.col("label") == old, new).otherwise(label)
    kind = F.when(is_cousin(), COUSIN).otherwise(TREE)
    rows = with_types(e, v, how="left").withColumn("_kind", kind).withColumn("_label", label).withColumn(
        "_k", _pair_key(F.col("src_type"), F.col("dst_type")))
    r = rules.select(
        _pair_key(F.col("from_type"), F.col("to_type")).alias("_k"), F.col("label").alias("r_label"),
        F.when(is_cousin(), COUSIN).otherwise(TREE).alias("_kind"), "multiplicity",
        F.when(F.col("direction") == "IN", F.col("to_type")).otherwise(F.col("from_type")).alias("r_src"),
        F.struct("contains_other_v", "delete_other_v", "prevent_delete").alias("_r"))
    several = r.groupBy("_k", "_kind").agg(
        F.count("*").alias("_n"), F.collect_list(F.struct("r_label", "multiplicity", "r_src", "_r")).alias("_all"))
    rows = rows.join(small(several), ["_k", "_kind"], "left").withColumn(
        "rule", F.when(F.col("_n") == 1, F.element_at("_all", 1)).otherwise(
            F.get(F.filter("_all", lambda x: x["r_label"] == F.col("_label")), F.lit(0))))
    ends = F.col("src_type").isNotNull() & F.col("dst_type").isNotNull()
    rows = rows.withColumn("_why", F.when(~ends, "missing end").when(F.col("rule").isNull(), "no rule"))
    skipped = rows.where("_why IS NOT NULL").select("eid", F.col("_why").alias("reason"))
    swap = (F.col("rule.r_src") == F.col("dst_type")) & (F.col("src_type") != F.col("dst_type"))
    cols = {"src": F.when(swap, F.col("dst")).otherwise(F.col("src")),
            "dst": F.when(swap, F.col("src")).otherwise(F.col("dst")),
            "label": F.col("rule.r_label"), "contains_other_v": F.col("rule._r.contains_other_v"),
            "delete_other_v": F.col("rule._r.delete_other_v"), "prevent_delete": F.col("rule._r.prevent_delete")}
    made = rows.where("_why IS NULL").select(
        *[cols[c].alias(c) if c in cols else F.col(c) for c in e.columns], "_k", F.col("rule.multiplicity").alias("multiplicity"))
    made = written(made, "rebuilt", "zstd")
    kept = _keep_first(made, ["_k", "label", "src"], "src")
    kept = written(_keep_first(kept, ["_k", "label", "dst"], "dst"), "rebuilt", "zstd")
    broken = made.join(kept.select("eid"), "eid", "left_anti").select("eid", F.lit("multiplicity").alias("reason"))
    return kept.select(*e.columns), skipped.unionByName(broken)


def swing_edges(
    e: DataFrame, v: DataFrame, pairs: DataFrame, other_type: str | None = None, label: str | None = None,
    direction: str = "BOTH",
) -> tuple[DataFrame, DataFrame]:
    """M5: (edges, moved edges).  ``pairs`` holds ``old`` and ``new`` of one type each.

    Matching edges leave the old vertex; one arrives at the new vertex unless
    that had this neighbour in the same direction before.  Of several old
    vertices bringing the same neighbour, the lowest id counts.
    """
    if direction not in ("BOTH", "IN", "OUT"):
        raise ValueError(f"direction must be BOTH, IN or OUT, not {direction}")
    t = v.select("vid", "node_type")
    pairs = pairs.select("old", "new").distinct().join(t.toDF("old", "_to"), "old").join(t.toDF("new", "_tn"), "new").where(
        F.col("_to") == F.col("_tn")).select("old", "new")
    pairs = few(pairs, "pairs")
    new_ends = few(pairs.select("new").distinct(), "new_ends")  # what they had is all that counts of the edges
    pool = e.where(F.col("label") == label) if label else e

    def side(near: str, far: str) -> DataFrame:
        rows = pool.withColumnRenamed(near, "old").withColumnRenamed(far, "other").join(pairs, "old")
        if other_type:
            rows = rows.join(v.where(F.col("node_type") == other_type).select(F.col("vid").alias("other")),
                             "other", "left_semi")
        return rows.withColumn("_near", F.lit(near))

    def had(near: str, far: str) -> DataFrame:
        return pool.select(F.col(near).alias("new"), F.col(far).alias("other"), F.lit(near).alias("_near")).join(
            new_ends, "new", "left_semi")

    ways = [w for w, d in ((("src", "dst"), "OUT"), (("dst", "src"), "IN")) if direction in ("BOTH", d)]
    gone = written(reduce(DataFrame.unionByName, [side(*w) for w in ways]), "swing")
    fresh = gone.join(reduce(DataFrame.unionByName, [had(*w) for w in ways]), ["new", "other", "_near"], "left_anti")
    first = fresh.groupBy("new", "other", "_near").agg(F.min("old").alias("old"))
    fresh = fresh.join(first, ["new", "other", "_near", "old"], "left_semi")
    cols = {"eid": F.concat(F.lit("swung:"), "eid"),
            "src": F.when(F.col("_near") == "src", F.col("new")).otherwise(F.col("other")),
            "dst": F.when(F.col("_near") == "src", F.col("other")).otherwise(F.col("new"))}
    moved = fresh.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in e.columns])
    rest = e.join(gone.select("eid").distinct(), "eid", "left_anti").select(*e.columns)
    return rest.unionByName(moved), moved


def create_edges(
    pairs: DataFrame, v: DataFrame, e: DataFrame, rules: DataFrame, kind: str = COUSIN, private: bool = False
) -> tuple[DataFrame, DataFrame]:
    """M7: (new edges, pairs without a rule) for the (a, b) pairs not yet joined by the rule's label."""
    t = v.select("vid", "node_type")
    rows = pairs.select("a", "b").distinct().join(t.toDF("a", "_ta"), "a").join(t.toDF("b", "_tb"), "b")
    rule = rules.where((is_cousin() if kind == COUSIN else ~is_cousin()) & (F.col("private") == private)).select(
        _pair_key(F.col("from_type"), F.col("to_type")).alias("_k"),
        F.when(F.col("direction") == "IN", F.col("to_type")).otherwise(F.col("from_type")).alias("_first"),
        "label", "is_default", "contains_other_v", "delete_other_v", "prevent_delete")
    cols = [c for c in rule.columns if c != "_k"]
    rule = small(rule.groupBy("_k").agg(F.max_by(F.struct(*cols), F.struct("is_default", "label")).alias("r")))
    rows = rows.withColumn("_k", _pair_key(F.col("_ta"), F.col("_tb"))).join(rule, "_k", "left")
    no_rule = rows.where("r IS NULL").select("a", "b")
    a_first = F.col("r._first") == F.col("_ta")
    made = rows.where("r IS NOT NULL").select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("src"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("dst"), "r.*").distinct()
    made = made.join(e.select("src", "dst", "label"), ["src", "dst", "label"], "left_anti")
    cols = {"eid": F.concat_ws(":", "label", "src", "dst"), "end_ts": F.lit(None).cast("long"), "props": empty_props()}
    return made.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in e.columns]), no_rule


# ---------------------------------------------------------------- merge

def merge_targets(pairs: DataFrame) -> DataFrame:
    """(secondary, primary) of pairs that may form chains, trees and cycles, each secondary led to the vertex that stays.

    Of a group of vertices connected by pairs the lowest one stays that no pair wants gone, or the lowest one where every
    pair wants every one gone.  Pairs of a vertex with itself, and null ends, are ignored.  A chain of n pairs takes about
    log n rounds.
    """
    pairs = written(pairs.where("secondary <> primary").select("secondary", "primary").distinct(), "merge_pairs")
    groups = components(pairs.select(F.col("secondary").alias("a"), F.col("primary").alias("b")))
    gone = pairs.select(F.col("secondary").alias("node"), F.lit(True).alias("gone")).distinct()
    known = groups.join(gone, "node", "left")
    keeper = known.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("gone").isNull(), F.col("node"))), F.min("node")).alias("primary"))
    return known.join(keeper, "component").where("node <> primary").select(F.col("node").alias("secondary"), "primary")


def merge_map(v: DataFrame, e: DataFrame, nt: DataFrame, pairs: DataFrame) -> DataFrame:
    """(secondary, primary) for the given pairs and, level by level, for their children of equal type and keys.

    The lowest id stands for several equal children of a primary.
    """
    types = small(nt).select("node_type", "keys")
    down = tree(e).select("parent_vid", "child_vid")
    level = cut(pairs.select("secondary", "primary").distinct(), "merge")
    out = level
    while True:  # down to the last level; a vertex is paired once, which also ends cycles
        both = level.select(F.explode(F.array("secondary", "primary")).alias("parent_vid")).distinct()
        kids = down.join(both, "parent_vid").join(
            v.select(F.col("vid").alias("child_vid"), "node_type", "props"), "child_vid").join(types, "node_type").select(
            "parent_vid", "child_vid", F.concat_ws("|", "node_type", key_str(F.col("keys"), F.col("props"))).alias("_k"),
            key_str(F.col("keys"), F.col("props")).isNotNull().alias("_ok")).where("_ok")
        kids = written(kids, "merge_kids")
        keep = kids.groupBy(F.col("parent_vid").alias("primary"), "_k").agg(F.min("child_vid").alias("_p"))
        drop = kids.select(F.col("parent_vid").alias("secondary"), "_k", "child_vid")
        level = cut(level.join(drop, "secondary").join(keep, ["primary", "_k"]).select(
            F.col("child_vid").alias("secondary"), F.col("_p").alias("primary")).where(
            "secondary <> primary").distinct().join(out.select("secondary"), "secondary", "left_anti"), "merge")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.groupBy("secondary").agg(F.min("primary").alias("primary"))


def merge_vertices(
    v: DataFrame, e: DataFrame, nt: DataFrame, pairs: DataFrame, force: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M6: (vertices, edges, merge map).  Where a vertex is both primary and secondary, ``merge_targets`` leads each to the one that stays.

    The primary takes the properties it lacks (and the ``force`` ones of its
    type), list properties are united, children without an equal and cousins
    not yet shared move over, the secondary goes.
    """
    pairs = written(pairs.select("secondary", "primary").distinct(), "merge_pairs")
    primaries = pairs.select(F.col("primary").alias("secondary")).distinct()
    if not pairs.join(primaries, "secondary", "left_semi").isEmpty():
        pairs = merge_targets(pairs)
    m = few(merge_map(v, e, nt, pairs), "merge_map")
    rows = m.join(v.select(F.col("vid").alias("secondary"), "props"), "secondary")
    facts = small(nt).select("node_type", "list_props")
    given = rows.select("primary", "secondary", F.explode("props").alias("key", "value")).join(
        v.select(F.col("vid").alias("primary"), "node_type", F.col("props").alias("own")), "primary").join(
        facts, "node_type", "left")
    is_list = F.coalesce(F.array_contains("list_props", F.col("key")), F.lit(False))
    forced = F.lit(False)
    for t, names in (force or {}).items():
        forced = forced | ((F.col("node_type") == t) & F.col("key").isin(*names))
    has = F.coalesce(F.map_contains_key("own", F.col("key")), F.lit(False))
    items = lambda c: F.when(c.isNotNull(), F.coalesce(F.from_json(c, "array<string>"), F.array(c)))
    single = given.where(~is_list & (~has | forced)).groupBy("primary", "key").agg(
        F.when(F.max(forced), F.max_by("value", "secondary")).otherwise(F.min_by("value", "secondary")).alias("value"))
    lists = given.where(is_list).select(
        "primary", "key", F.explode(F.array_union(items(F.col("value")), F.coalesce(
            items(F.element_at("own", F.col("key"))), F.array().cast("array<string>")))).alias("x")).where("x IS NOT NULL")
    lists = lists.groupBy("primary", "key").agg(F.to_json(F.array_sort(F.collect_set("x"))).alias("value"))
    news = single.unionByName(lists).groupBy(F.col("primary").alias("vid")).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    kept = v.join(m.select(F.col("secondary").alias("vid")), "vid", "left_anti").join(news, "vid", "left")
    merged = F.map_concat(F.map_filter(F.coalesce("props", empty_props()),
                                       lambda k, _: ~F.map_contains_key("_new", k)), F.col("_new"))
    v2 = kept.withColumn("props", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("props"))).select(*v.columns)

    end = lambda s: m.select(F.col("secondary").alias(s), F.col("primary").alias(f"_{s}"))
    rows = e.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    hit = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    child_end = F.when(F.col("contains_other_v") == "IN", F.col("_src")).otherwise(F.col("_dst"))
    touched = written(rows.where(hit & (is_cousin() | child_end.isNull())), "touched")
    repl = {"eid": F.concat(F.lit("merged:"), "eid"), "src": F.coalesce("_src", "src"), "dst": F.coalesce("_dst", "dst")}
    moved = touched.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in e.columns])
    # cousins the primary has already are dropped, in either direction
    old = rows.where(~hit)
    have = neighbours(old.where(is_cousin())).select(F.col("vid").alias("src"), F.col("other_vid").alias("dst"))
    loose = moved.where(is_cousin()).join(have, ["src", "dst"], "left_anti")
    first = loose.groupBy("src", "dst", "label").agg(F.min("eid").alias("eid")).select("eid")
    loose = loose.join(first, "eid", "left_semi").select(*e.columns)
    e2 = old.select(*e.columns).unionByName(moved.where(~is_cousin())).unionByName(loose)
    return v2, e2, m


# ---------------------------------------------------------------- URIs

def uri_segment(template: Column, keys: Column, props: Column) -> Column:
    """The type's URI template with its keys filled in; null if a key is missing."""
    filled = F.aggregate(keys, template, lambda acc, k: F.replace(
        acc, F.concat(F.lit("{"), k, F.lit("}")), url_encode(F.element_at(props, k))))
    return F.when(key_str(keys, props).isNotNull(), filled)


def rebuild_uris(
    v: DataFrame, e: DataFrame, nt: DataFrame, roots: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """M8: (vertices, visited (vid, uri)).  From the top-level types (or only their vertices among
    ``roots``) down every containment edge, each vertex once; of several parents on one level the
    lowest URI counts.

    A vertex whose keys are missing keeps its URI, and so does all below it.
    Visited vertices without a uuid get one derived from their URI.
    """
    types = small(nt).select("node_type", "keys", "top_level", "uri_template")
    links = neighbours(e.where(~is_cousin())).select("vid", "other_vid")
    segment = uri_segment(F.col("uri_template"), F.col("keys"), F.col("props")).alias("seg")
    facts = v.select("vid", "node_type", "props").join(types, "node_type")
    if roots is None:  # nearly all vertices will be reached: their segments are made once, without the properties
        facts = cut(facts.select("vid", "top_level", segment), "segments")
        links, segment = cut(links, "containment"), F.col("seg")
    level = facts.where("top_level")
    if roots is not None:
        level = level.join(roots.select("vid").distinct(), "vid", "left_semi")
    seen = level = cut(level.select("vid", segment.alias("uri")), "uris")
    while True:  # down to the last level; a vertex is visited once, which also ends cycles
        # with ``roots``, segments are made for the vertices a level reaches, not for all
        nxt = level.where("uri IS NOT NULL").join(links, "vid").groupBy(F.col("other_vid").alias("vid")).agg(
            F.min("uri").alias("_up")).join(seen.select("vid"), "vid", "left_anti").join(facts, "vid").select(
            "vid", "_up", segment).select("vid", F.concat("_up", "seg").alias("uri"))
        level = cut(nxt, "uris")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    done = seen.where("uri IS NOT NULL").select("vid", F.col("uri").alias("_uri"))
    out = v.join(done, "vid", "left")
    cols = {"uri": F.coalesce("_uri", "uri"),
            "uuid": F.when(F.col("_uri").isNotNull() & blank(F.col("uuid")), F.md5(F.col("_uri").cast("binary"))).otherwise(
                F.col("uuid"))}
    return out.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in v.columns]), done.select(
        "vid", F.col("_uri").alias("uri"))


# ---------------------------------------------------------------- running

@dataclass
class Outcome:
    """What a migration hands back; ``fallout`` rows are (line, reason).

    ``changed`` names vertices (``vid``) whose properties changed, which a commit touches, or edges (``eid``), which it
    doesn't.  A commit adds ``events``, the change lines of the touched vertices, and ``deletes``, the vertices that went.
    """

    v: DataFrame
    e: DataFrame
    changed: DataFrame | None = None
    fallout: DataFrame | None = None
    status: str = SUCCESS
    events: DataFrame | None = None
    deletes: DataFrame | None = None


@dataclass(frozen=True)
class Migration:
    name: str
    run: Callable[[Graph], Outcome]
    priority: int = 0
    enabled: bool = True


@dataclass
class Options:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    run_disabled: list[str] = field(default_factory=list)
    forced: bool = False
    commit: bool = False
    now_ms: int | None = None  # time of the run, by default the present


def _write_tables(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    return {k: cut(df, k, (PARTITIONED[k],)) for k, df in tables.items()}


def commit_outcome(g: Graph, out: Outcome, now_ms: int, name: str = "", write: Callable = _write_tables) -> Graph:
    """The graph after a successful migration: changed vertices touched (M11), changed tables written, others kept.

    ``write(tables, name)`` writes the changed ones together and returns what it wrote.
    """
    ids = out.changed.select("vid").distinct() if out.changed is not None and "vid" in out.changed.columns else None
    v = out.v
    if ids is not None:
        ids = few(ids, "changed")
        v = touch(v, ids, now_ms)
    done = write({k: df for k, df, before in (("vertices", v, g.v), ("edges", out.e, g.e)) if df is not before}, name)
    if "vertices" in done:
        v = done["vertices"]
        out.deletes = g.v.select("vid", "node_type", "uri").join(v.select("vid"), "vid", "left_anti")
    if ids is not None:
        out.events = v.join(ids, "vid", "left_semi").select(
            F.lit(now_ms).cast("long").alias("ts"), "vid", F.col("resource_version").alias("version"))
    return Graph(v, done.get("edges", g.e), g.nt, g.rules)


def run_migrations(
    spark: SparkSession, g: Graph, registry: list[Migration], ledger: DataFrame, opts: Options | None = None,
    write: Callable = _write_tables,
) -> tuple[Graph, DataFrame, DataFrame, list[tuple[str, Outcome]]]:
    """M9: (graph, ledger, summary, outcomes).

    Migrations run in priority order; one in the ledger is skipped unless
    forced.  A change is kept, as newly written tables where there is one, and
    recorded only with ``commit`` and status SUCCESS; its outcome then has the
    change and delete rows for S11 and P4.
    """
    opts = opts or Options()
    now_ms = int(time.time() * 1000) if opts.now_ms is None else opts.now_ms
    names = {r["name"] for r in ledger.select("name").distinct().join(
        spark.createDataFrame([(m.name,) for m in registry], "name string"), "name", "left_semi").collect()}
    chosen = [m for m in registry if m.name not in opts.exclude and (not opts.include or m.name in opts.include)]
    chosen.sort(key=lambda m: (m.priority, m.name))
    results, outcomes, new = [], [], []
    for m in chosen:
        if not m.enabled and m.name not in opts.run_disabled:
            results.append((m.name, "disabled"))
            continue
        if m.name in names and not opts.forced:
            results.append((m.name, "already run"))
            continue
        out = m.run(g)
        outcomes.append((m.name, out))
        if out.status == FAILURE:
            results.append((m.name, "failed, rolled back"))
        elif out.status == CHECK_LOGS:
            results.append((m.name, "check logs, rolled back"))
        elif not opts.commit:
            results.append((m.name, "not committed"))
        else:
            g = commit_outcome(g, out, now_ms, m.name, write)
            new.append((m.name,))
            results.append((m.name, "committed"))
    if new:
        ledger = ledger.select("name").unionByName(spark.createDataFrame(new, "name string")).distinct()
    summary = spark.createDataFrame([(i, *r) for i, r in enumerate(results)], "step int, name string, result string")
    return g, ledger, summary, outcomes


def run_versioned(
    store: VersionedStore, nt: DataFrame, rules: DataFrame, registry: list[Migration], opts: Options | None = None,
) -> tuple[Graph, DataFrame, list[tuple[str, Outcome]]]:
    """M9 on a versioned store: (graph, summary, outcomes).

    The run reads one version, and each committed migration becomes the next one: its vertices, edges and ledger entry
    together, or none of them.  Another writer's commit meanwhile raises ``Conflict`` at the next migration's, which then
    leaves nothing; earlier ones stay.  ``store.roll_back`` undoes any number of them.
    """
    opts = opts or Options()
    now_ms = int(time.time() * 1000) if opts.now_ms is None else opts.now_ms
    version = store.latest()
    g = Graph(store.read("vertices", version), store.read("edges", version), nt, rules)

    def write(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
        nonlocal version
        version = store.commit(version, tables, [{"name": name, "ts": now_ms}], PARTITIONED)
        return {k: store.read(k, version) for k in tables}

    names = [(x["name"],) for x in store.manifest(version)["ledger"]]
    ledger = store.spark.createDataFrame(names, "name string")
    g, _, summary, outcomes = run_migrations(store.spark, g, registry, ledger, replace(opts, now_ms=now_ms), write)
    return g, summary, outcomes


def migration_summary(spark: SparkSession, outcomes: list[tuple[str, Outcome]]) -> DataFrame:
    """(name, status, n_changed, n_fallout) per migration."""
    rows = []
    for name, o in outcomes:
        count = lambda df, col: (df if df is not None else spark.range(0)).agg(F.count("*").alias(col))
        row = one_row(count(o.changed, "n_changed"), count(o.fallout, "n_fallout"))
        rows.append(row.select(F.lit(name).alias("name"), F.lit(o.status).alias("status"), "n_changed", "n_fallout"))
    if not rows:
        return spark.createDataFrame([], "name string, status string, n_changed bigint, n_fallout bigint")
    return reduce(DataFrame.unionByName, rows)


def fallout_rows(outcomes: list[tuple[str, Outcome]]) -> DataFrame | None:
    """(name, line, reason) of all rejected feed rows."""
    parts = [o.fallout.select(F.lit(n).alias("name"), "line", "reason") for n, o in outcomes if o.fallout is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None
