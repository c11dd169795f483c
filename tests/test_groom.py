import random

import pytest
from pyspark.sql import functions as F

from graphwarden.operators import dupes, groom, repair


def inventory(tiny):
    """A region with a tenant, and one of each defect."""
    return (
        tiny.type("region", ["id"], top=True).type("tenant", ["id"], ["region"])
        .v(1, "region", id="r").v(2, "tenant", id="t").e(2, 1, contains="IN")
        .v(3, "tenant", id="orphan")
        .v(4, "region", uri="/4")                      # key missing, URI fine
        .v(5, "region", uri="")                        # ghost
        .v(6, "region", uri="/1", id="thief")          # URI leads to 1
        .v(7, None)                                    # no type
        .v(8, "tenant", id="two").e(8, 1, contains="IN").e(8, 6, contains="IN")
        .v(9, "tenant", id="gone", uuid="9dummy")
        .v(10, "odd")                                  # type nobody knows
        .e(1, 99, eid="dangling").e(1, 7, eid="untyped").e(1, 4, eid="keyless").e(1, 10, eid="fine")
        .graph())


def test_each_finding(tiny, rows):
    g = inventory(tiny)
    find = lambda f: rows(f(g.v, g.e, g.nt).select("vid"))
    assert find(groom.find_orphans) == [(3,)]
    assert find(groom.find_missing_type) == [(7,), (9,)]
    assert find(groom.find_bad_uri) == [(6,)]
    assert find(groom.find_bad_key) == [(4,)]
    assert find(groom.find_ghosts) == [(5,)]
    assert find(groom.find_multi_parent) == [(8,)]
    assert rows(groom.find_bad_edges(g.v, g.e, g.nt).select("eid", "bad_vid", "reason")) == [
        ("dangling", 99, "absent"), ("keyless", 4, "missing_keys"), ("untyped", 7, "untyped")]
    assert rows(groom.find_dangling_ends(g.v, g.e)) == [("dangling", "dst", 99)]


def test_strict_uri_index_accepts_only_unique_uris(tiny, rows):
    g = inventory(tiny)
    checks = groom.vertex_checks(g.v, g.e, g.nt, strict_uri=True)
    assert rows(checks.where("NOT uri_ok").select("vid")) == [(1,), (5,), (6,)]


def test_summary_and_candidates(tiny, rows):
    g = inventory(tiny)
    f = groom.groom(g.v, g.e, g.nt)
    s = groom.groom_summary(f).first()
    assert (s.nodes_seen, s.ghosts, s.orphans, s.bad_uris, s.bad_keys, s.missing_types, s.bad_edges, s.run_type) == (
        8, 1, 1, 1, 1, 2, 3, "FULL")
    kinds = dict(groom.delete_candidates(f).groupBy("kind").count().collect())
    assert kinds == {"Phantom": 1, "Orphan": 1, "Missing Type": 2, "Bad Edge": 3}


def test_repair_leaves_nothing_to_find(tiny):
    g = inventory(tiny)
    f = groom.groom(g.v, g.e, g.nt)
    v, e = repair.fix_bad_edges(g.v, g.e, f.bad_edges)
    gone = groom.delete_candidates(f).where("kind <> 'Bad Edge'").select(F.col("id").cast("long").alias("vid"))
    v, e = repair.delete_vertices(v, e, gone)
    again = groom.groom(v, e, g.nt)
    assert groom.delete_candidates(again).isEmpty()
    assert groom.find_dangling_ends(v, e).isEmpty()


def test_cap_fixes_nothing_above_the_limit(tiny):
    g = inventory(tiny)
    c = groom.delete_candidates(groom.groom(g.v, g.e, g.nt))
    assert repair.apply_cap(c, 6).isEmpty()
    assert repair.apply_cap(c, 7).count() == 7
    assert {r.kind for r in repair.select_candidates(c, edges_only=True).collect()} == {"Bad Edge"}


def test_guard_reasons(tiny, rows, spark):
    t = tiny.v(1, "cloud-region")
    for i in range(2, 14):
        t.v(i, "x").e(1, i, contains="OUT")
    g = t.graph()
    ids = spark.createDataFrame([(1,), (2,), (99,)], "vid long")
    got = rows(repair.guard_delete(g.v, g.e, ids).select("vid", "n_edges", "n_descendants", "allowed", "reasons"))
    assert got == [(1, 12, 12, False, "descendants|edges|protected_type"), (2, 1, 0, True, ""), (99, 0, 0, False, "not_found")]
    assert rows(repair.guard_delete(g.v, g.e, ids, override=True).where("NOT allowed").select("vid")) == [(99,)]


def test_dummy_fill(tiny, spark):
    g = tiny.v(5, None).graph()
    nt = spark.createDataFrame(
        [("t", ["a", "b", "c", "d"], {"a": "String", "b": "Long", "c": "Boolean", "d": "Integer"})],
        "node_type string, indexed array<string>, prop_types map<string,string>")
    r = repair.fill_dummy_props(g.v, nt, "t").first()
    assert (r.node_type, r.uuid, r.props["a"], r.props["b"], r.props["c"], r.props["d"]) == (
        "t", "5dummy", "5dummy", "5", "false", "9999")


# ---------------------------------------------------------------- duplicates

def brute_fold(members, uri_of, owner, links):
    """The keeper of one group, member by member."""
    uris = {uri_of[m] for m in members}
    if len(uris) != 1 or "" in uris:
        return None
    cur = members[0]
    for b in members[1:]:
        a, la, lb = cur, links[cur], links[b]
        sa, sb = set(la), set(lb)
        if len(la) == len(lb):
            pick = None if not sa <= sb else a if owner[uri_of[a]] == a else b if owner[uri_of[b]] == b else None
        elif len(la) > len(lb):
            pick = a if sb <= sa else None
        else:
            pick = b if sa <= sb else None
        if pick is None:
            return None
        cur = pick
    return cur if owner[uri_of[cur]] == cur else None


@pytest.mark.parametrize("seed", range(3))
def test_keeper_equals_the_member_by_member_fold(tiny, seed):
    rnd = random.Random(seed)
    t = tiny.type("t", ["id"], top=True).type("far", ["id"], top=True)
    uri_of, links, groups = {}, {}, {}
    for i in range(12):
        t.v(1000 + i, "far", id=i)
    vid = 1
    for key in range(80):
        members = list(range(vid, vid + rnd.choice([2, 2, 3, 4])))
        vid += len(members)
        groups[key] = members
        pool = [1000 + rnd.randrange(12) for _ in range(rnd.randrange(5))]
        for m in members:
            uri_of[m] = rnd.choice([f"/{key}"] * 8 + ["", f"/other{key}"])
            links[m] = pool[:rnd.randrange(len(pool) + 1)] if rnd.random() < 0.8 else [1000 + rnd.randrange(12)]
            t.v(m, "t", uri=uri_of[m], id=key)
            for far in links[m]:
                t.e(m, far) if rnd.random() < 0.5 else t.e(far, m)
    g = t.graph()
    owner = {}
    for m, u in sorted(uri_of.items()):
        owner.setdefault(u, m)
    found = dupes.find_dupe_groups(g.v, g.e, g.nt)
    got = {r.group_id: r.keeper_vid for r in dupes.choose_keeper(found, g.v, g.e, g.nt).collect()}
    want = {m[0]: brute_fold(m, uri_of, owner, links) for m in groups.values()}
    assert {k: got[k] for k in want} == want
    assert any(want.values()) and not all(want.values())


def test_dependent_groups_need_the_same_parent(tiny, rows):
    g = (tiny.type("region", ["id"], top=True).type("tenant", ["id"], ["region"])
         .v(1, "region", id="a").v(2, "region", id="b")
         .v(3, "tenant", id="t").v(4, "tenant", id="t").v(5, "tenant", id="t")
         .e(3, 1, contains="IN").e(4, 1, contains="IN").e(5, 2, contains="IN").graph())
    assert rows(dupes.find_dupe_groups_dep(g.v, g.e, g.nt).select("group_id", "parent_vid", "vid")) == [(3, 1, 3), (3, 1, 4)]


def test_special_rule_prefers_the_subscription(tiny, spark, rows):
    g = (tiny.type("cloud-region", ["id"], top=True).type("tenant", ["id"], ["cloud-region"])
         .type("vserver", ["id"]).type("service-subscription", ["id"])
         .v(1, "cloud-region", id="r").v(2, "tenant", uri="/t", id="t").v(3, "tenant", uri="/t", id="t")
         .v(4, "service-subscription", id="s").v(5, "vserver", id="v")
         .e(2, 1, contains="IN").e(3, 1, contains="IN").e(2, 4).e(3, 5).graph())
    pairs = spark.createDataFrame([(2, 3)], "a long, b long")
    assert rows(dupes.pick_of_two(pairs, g.v, g.e, g.nt)) == [(2, 3, None)]
    assert rows(dupes.pick_of_two(pairs, g.v, g.e, g.nt, dupes.SpecialRule())) == [(2, 3, 2)]


def test_confirm_needs_every_loser_twice(spark, rows):
    make = lambda x: spark.createDataFrame(x, "keeper_vid long, vid long")
    first = make([(1, 1), (1, 2), (4, 4), (4, 5)])
    second = make([(1, 1), (1, 2), (4, 4), (4, 5), (4, 6), (None, 9)])
    assert rows(dupes.confirm_dupes(first, second)) == [(1, 2)]


def test_one_group_may_hold_a_third_of_all_vertices(spark):
    """Members stay rows: 4,000 copies of one vertex next to 8,000 others."""
    from graphwarden.model import NODE_TYPE_DDL
    n = 12_000
    hot = F.col("id") < 4_000
    v = spark.range(n).select(
        F.col("id").alias("vid"), F.lit("t").alias("node_type"),
        F.when(hot, "/hot").otherwise(F.concat(F.lit("/"), F.col("id").cast("string"))).alias("uri"),
        F.create_map(F.lit("id"), F.when(hot, "hot").otherwise(F.col("id").cast("string"))).alias("props"))
    e = spark.range(4_000).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("eid"), F.col("id").alias("src"), F.lit(11_999).cast("long").alias("dst"),
        F.lit("L").alias("label"), F.lit("NONE").alias("contains_other_v"))
    nt = spark.createDataFrame([("t", ["id"], [], True, ["id"], [], [], [], {}, "")], NODE_TYPE_DDL)
    got = dupes.choose_keeper(dupes.find_dupe_groups(v, e, nt), v, e, nt).collect()
    assert [(r.group_id, r.n_members, r.keeper_vid) for r in got] == [(0, 4_000, 0)]
