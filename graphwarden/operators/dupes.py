"""Duplicate groups and the copy worth keeping.

Groups stay in row form, one row per member, so that a group holding a large
share of the graph never becomes one array or one task.

The keeper of a group is defined by a fold over its members in id order, each
step picking one of two.  The fold can only end in a vertex its URI leads to;
that is the lowest id of the URI, hence the first member.  So the fold ends
well exactly if the first member wins against every other member, and that is
a join and a count per group instead of a sequential pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from graphwarden.functions.bounds import small
from graphwarden.functions.keys import blank, key_str
from graphwarden.functions.storage import cut, written
from graphwarden.operators.structure import neighbours, tree

GROUP = ["group_id", "parent_vid"]
MEMBER_COLS = ["group_id", "parent_vid", "node_type", "key_str", "vid", "n_members"]


@dataclass(frozen=True)
class SpecialRule:
    """Of two ``node_type`` vertices with two neighbours each, keep the one next to
    ``prefer`` when the other is next to ``over``."""

    node_type: str = "tenant"
    prefer: str = "service-subscription"
    over: str = "vserver"


def _keyed(v: DataFrame, nt: DataFrame) -> DataFrame:
    types = small(nt).select("node_type", "keys", "dependent_on")
    return v.join(types, "node_type").select(
        "vid", "node_type", "dependent_on", key_str(F.col("keys"), F.col("props")).alias("key_str")
    ).where(F.col("key_str").isNotNull())


def _members(rows: DataFrame) -> DataFrame:
    by = ["node_type", "key_str", "parent_vid"]
    groups = rows.groupBy(*by).agg(F.count("*").alias("n_members"), F.min("vid").alias("group_id")).where(
        F.col("n_members") > 1)
    return rows.join(groups, by).select(*MEMBER_COLS)


def find_dupe_groups_top(v: DataFrame, nt: DataFrame) -> DataFrame:
    """Members sharing type and keys, for types that depend on no parent (parent_vid = -1)."""
    rows = _keyed(v, nt).where(F.size("dependent_on") == 0)
    return _members(rows.select("vid", "node_type", "key_str", F.lit(-1).cast("long").alias("parent_vid")))


def find_dupe_groups_dep(v: DataFrame, e: DataFrame, nt: DataFrame) -> DataFrame:
    """Members sharing type, keys and a parent of a type they depend on."""
    kids = _keyed(v, nt).where(F.size("dependent_on") > 0).drop("dependent_on")
    up = tree(e).select(F.col("child_vid").alias("vid"), "parent_vid").distinct()
    # (type, parent type) as allowed; vertices whose type is nobody's parent are not shuffled
    allowed = small(nt.select("node_type", F.explode("dependent_on").alias("_ptype")).distinct())
    over = v.select(F.col("vid").alias("parent_vid"), F.col("node_type").alias("_ptype")).join(
        allowed.select("_ptype"), "_ptype", "left_semi")
    rows = kids.join(up, "vid").join(over, "parent_vid").join(allowed, ["node_type", "_ptype"], "left_semi")
    return _members(rows.select("vid", "node_type", "key_str", "parent_vid"))


def find_dupe_groups(v: DataFrame, e: DataFrame, nt: DataFrame) -> DataFrame:
    """Members of all duplicate groups."""
    return find_dupe_groups_top(v, nt).unionByName(find_dupe_groups_dep(v, e, nt))


def drop_found(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members whose vertex is not yet in a found group."""
    return members.join(found.select("vid").distinct(), "vid", "left_anti")


def _link_counts(vids: DataFrame, e: DataFrame) -> DataFrame:
    """(vid, other_vid, n): neighbours of the given vertices with multiplicity."""
    ends = neighbours(e).select("vid", "other_vid")
    return ends.join(vids.select("vid").distinct(), "vid", "left_semi").groupBy("vid", "other_vid").agg(
        F.count("*").alias("n"))


def compare_pairs(
    pairs: DataFrame, v: DataFrame, e: DataFrame, rule: SpecialRule | None = None
) -> DataFrame:
    """Per pair (a, b): neighbour counts, distinct neighbours and how many of b's are a's.

    Only b's links are expanded; a's links are probed, so a hub shared by many
    pairs is never copied per pair.
    """
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("vid"))
    links = cut(_link_counts(ids, e), "links", compression="zstd")
    aggs = [F.sum("n").alias("deg"), F.count("*").alias("dist")]
    if rule is not None:
        far = v.where(F.col("node_type").isin(rule.prefer, rule.over)).select(
            F.col("vid").alias("other_vid"), F.col("node_type").alias("_far"))
        links = links.join(far, "other_vid", "left")
        aggs += [F.max(F.coalesce(F.col("_far") == t, F.lit(False))).alias(name)
                 for t, name in ((rule.prefer, "pref"), (rule.over, "over"))]
    stats = links.groupBy("vid").agg(*aggs)
    side = lambda s: stats.select(
        F.col("vid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in stats.columns if c != "vid"])
    probe = links.select(F.col("vid").alias("a"), "other_vid")
    shared = (
        pairs.select("a", "b").distinct()
        .join(links.select(F.col("vid").alias("b"), "other_vid"), "b")
        .join(probe, ["a", "other_vid"], "left_semi")
        .groupBy("a", "b").agg(F.count("*").alias("common"))
    )
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").join(shared, ["a", "b"], "left")
    zero = {c: 0 for c in ("a_deg", "a_dist", "b_deg", "b_dist", "common")}
    return out.fillna(zero)


def _special(rule: SpecialRule | None, node_type: Column, winner: str, loser: str) -> Column:
    if rule is None:
        return F.lit(False)
    ok = (node_type == rule.node_type) & (F.col("a_deg") == 2) & F.col(f"{winner}_pref") & F.col(f"{loser}_over")
    return F.coalesce(ok, F.lit(False))


def pick_of_two(
    pairs: DataFrame, v: DataFrame, e: DataFrame, nt: DataFrame, rule: SpecialRule | None = None
) -> DataFrame:
    """G11 (G14 with ``rule``): (a, b, keeper_vid); null when no copy is safe to keep."""
    from graphwarden.operators.groom import uri_owners

    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    keyed = written(_keyed(v.join(ids, "vid", "left_semi"), nt), "keyed")
    up = neighbours(e).select("vid", "other_vid").join(keyed.select("vid", "dependent_on"), "vid").join(
        v.select(F.col("vid").alias("other_vid"), F.col("node_type").alias("_ptype")), "other_vid")
    dep_parent = up.where(F.array_contains("dependent_on", F.col("_ptype"))).groupBy("vid").agg(
        F.max("other_vid").alias("dep_parent"))
    owners = uri_owners(v).join(ids, "vid", "left_semi").withColumn("ok", F.lit(True))
    facts = keyed.join(owners, "vid", "left").join(dep_parent, "vid", "left").select(
        "vid", F.struct("node_type", "key_str", "dep_parent", F.size("dependent_on").alias("n_dep"),
                        F.coalesce("ok", F.lit(False)).alias("ok")).alias("f"))
    facts = written(facts, "facts")
    rows = compare_pairs(pairs, v, e, rule)
    for s in ("a", "b"):
        rows = rows.join(facts.select(F.col("vid").alias(s), F.col("f").alias(f"f{s}")), s, "left")
    c = F.col
    same = (c("fa.node_type") == c("fb.node_type")) & (c("fa.key_str") == c("fb.key_str")) & (
        (c("fa.n_dep") == 0) | (c("fa.dep_parent") == c("fb.dep_parent")))
    a_in_b, b_in_a = c("common") == c("a_dist"), c("common") == c("b_dist")
    equal_size = F.when(a_in_b, F.when(c("fa.ok"), c("a")).when(c("fb.ok"), c("b"))).when(
        _special(rule, c("fa.node_type"), "b", "a"), c("b")).when(
        _special(rule, c("fa.node_type"), "a", "b"), c("a"))
    pick = (
        F.when(~F.coalesce(same, F.lit(False)), F.lit(None))
        .when(c("a_deg") == c("b_deg"), equal_size)
        .when((c("a_deg") > c("b_deg")) & b_in_a, c("a"))
        .when((c("b_deg") > c("a_deg")) & a_in_b, c("b")))
    return rows.select("a", "b", pick.cast("long").alias("keeper_vid"))


def choose_keeper(
    groups: DataFrame, v: DataFrame, e: DataFrame, nt: DataFrame, rule: SpecialRule | None = None,
    owners: DataFrame | None = None,
) -> DataFrame:
    """(group_id, parent_vid, n_members, keeper_vid); null keeper means undetermined.

    ``owners`` gives (vid) of ``uri_owners`` among the vertices of known types where they are known.
    """
    from graphwarden.operators.groom import uri_owners

    c = F.col
    groups = written(groups, "groups")
    owners = (uri_owners(v) if owners is None else owners).select(c("vid").alias("group_id"))
    uris = groups.select(*GROUP, "vid").join(v.select("vid", "uri"), "vid").groupBy(*GROUP).agg(
        F.count("*").alias("n_members"),
        ((F.min("uri") == F.max("uri")) & ~F.max(blank(c("uri")))).alias("_one_uri"))
    uris = written(uris, "group_uris")
    # only groups whose first member can be kept need their neighbours compared
    hopeful = uris.where("_one_uri").join(owners, "group_id", "left_semi").select(*GROUP)
    pairs = groups.where(c("vid") != c("group_id")).join(hopeful, GROUP, "left_semi").select(
        c("group_id").alias("a"), c("vid").alias("b"), "parent_vid", "node_type")
    rows = compare_pairs(pairs, v, e, rule)
    first_wins = (
        F.when(c("a_deg") > c("b_deg"), c("common") == c("b_dist"))
        .when(c("a_deg") == c("b_deg"),
              (c("common") == c("a_dist")) | _special(rule, c("node_type"), "a", "b"))
        .otherwise(False))
    kept = rows.groupBy(c("a").alias("group_id"), "parent_vid").agg(F.min(first_wins).alias("_wins")).where(
        "_wins").drop("_wins").withColumn("keeper_vid", c("group_id"))
    return uris.join(kept, GROUP, "left").select(*GROUP, "n_members", "keeper_vid")


def with_keeper(groups: DataFrame, keepers: DataFrame) -> DataFrame:
    """Members with the keeper of their group."""
    return groups.join(keepers.select(*GROUP, "keeper_vid"), GROUP, "left")


def confirm_dupes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(keeper_vid, vid) of run 2 for keepers whose run-2 losers were all losers in run 1."""
    losers = lambda d: d.where(
        F.col("keeper_vid").isNotNull() & (F.col("vid") != F.col("keeper_vid"))
    ).select("keeper_vid", "vid").distinct()
    new = losers(second).join(losers(first), ["keeper_vid", "vid"], "left_anti")
    return losers(second).join(new.select("keeper_vid").distinct(), "keeper_vid", "left_anti")
