"""Bucketed graphs, the kept map of ids, and long chains in few rounds."""

import random
import re

import pytest

from graphwarden.functions import storage
from graphwarden.functions.storage import new_path
from graphwarden.functions.versions import VersionedStore
from graphwarden.operators import audit, groom, migrate, structure as st
from graphwarden.sources import bucketed, id_map
from graphwarden.sources.snapshot import LoadFailed


@pytest.fixture
def wide(spark):
    """No automatic broadcasts: the joins are those of large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def random_graph(tiny, n=60, m=300, seed=3):
    draw = random.Random(seed)
    tiny.type("a", ["id"]).type("b", ["id"]).rule("a", "a", "L").rule("a", "b", "L").rule("b", "b", "L", multiplicity="MANY2ONE")
    for i in range(n):
        tiny.v(i, draw.choice(["a", "b", None]), id=i)
    for _ in range(m):  # a third of all edges leaves vertex 0, a third arrives there, some ends are absent
        src, dst = draw.choice([(0, draw.randrange(n + 5)), (draw.randrange(n + 5), 0), (draw.randrange(n), draw.randrange(n))])
        tiny.e(src, dst, contains=draw.choice(["OUT", "IN", "NONE"]))
    return tiny.graph()


def exchanges(df):
    """Keys of the exchanges of a plan, without the numbers of columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]


def test_bucketed_operators_equal_plain_ones(tiny, wide, rows):
    g = random_graph(tiny)
    b = bucketed.write_graph(g)
    assert b.out.hub_ids.count() == b.into.hub_ids.count() == 1 and b.out.hubs.count() > 100
    again = bucketed.open_graph(wide, b.path, g.nt, g.rules)
    for x in (b, again):
        assert rows(x.out.all().select("eid")) == rows(x.into.all().select("eid")) == rows(g.e.select("eid"))
    assert rows(st.bucketed_parents(again)) == rows(st.parents(g.v, g.e).select(*st.bucketed_parents(b).columns))
    near = st.neighbours(g.e).join(g.v.select("vid"), "vid", "left_semi").groupBy("vid").count()
    assert rows(st.bucketed_neighbours(b).select("vid", "n")) == rows(near)
    checks = groom.vertex_checks(g.v, g.e, g.nt)
    counted = groom.vertex_checks(b.v, None, b.nt, counts=st.bucketed_parents(b).select("vid", "n_parents"))
    assert rows(counted) == rows(checks)
    for edges in (b.out, b.into):
        assert rows(groom.bad_edges_from(b.v, edges, b.nt, counted)) == rows(groom.bad_edges_from(g.v, g.e, g.nt, checks))
        assert rows(audit.edge_counts(edges, b.v, b.rules, b.nt)) == rows(audit.edge_counts(g.e, g.v, g.rules, g.nt))
        for new, old in zip(migrate.rebuild_edges(edges, b.v, b.rules), migrate.rebuild_edges(g.e, g.v, g.rules)):
            assert rows(new.drop("props")) == rows(old.drop("props"))


def test_bucketed_tables_are_not_exchanged(tiny, wide):
    """Tables meet in place; what is shuffled came out of a join and goes to the other end."""
    b = bucketed.write_graph(random_graph(tiny))
    assert set(exchanges(st.bucketed_parents(b))) <= {"src, 8", "dst, 8"}  # partial counts of hubs
    for frame in (migrate.with_types(b.out, b.v), migrate.with_types(b.out, b.v, how="left")):
        keys = exchanges(frame)
        assert keys and all(k.split(",")[0] == "dst" for k in keys), keys
    plain = migrate.with_types(b.out.all(), b.v)
    assert len(exchanges(plain)) > len(exchanges(migrate.with_types(b.out, b.v)))


def test_empty_bucketed_graph(tiny, rows):
    g = tiny.type("a", ["id"]).graph()
    b = bucketed.write_graph(g)
    assert rows(st.bucketed_parents(b)) == rows(migrate.with_types(b.out, b.v)) == []


def test_ids_go_on_after_a_broken_load(tiny, spark, rows):
    g = tiny.type("a", ["id"]).v(5, "a").v(3, "a").e(5, 3, eid="x").e(3, 9, eid="y").graph()
    store = VersionedStore(spark, new_path(spark, "ids"))
    with pytest.raises(LoadFailed):
        id_map.load(store, g.v, g.e, first=100, max_errors=0)
    first = rows(id_map.id_map(store))
    assert first == [(3, 100), (5, 101)] and "vertices" not in store.manifest()["tables"]
    g = tiny.v(9, "a").v(1, "a").graph()
    id_map.load(store, g.v, g.e, first=100, max_errors=0)
    assert rows(id_map.id_map(store)) == [(1, 102), (3, 100), (5, 101), (9, 103)]
    assert rows(store.read("edges").select("eid", "src", "dst")) == [("x", 101, 100), ("y", 100, 103)]
    assert rows(store.read("vertices").select("vid")) == [(100,), (101,), (102,), (103,)]
    version = store.latest()
    id_map.load(store, g.v, g.e, first=7)  # nothing new: no version of the map
    assert store.latest() == version + 1 and rows(id_map.id_map(store))[0] == (1, 102)


def test_unmapped_ends_are_error_rows(tiny, spark, rows):
    g = tiny.type("a", ["id"]).v(1, "a").v(2, "a").e(1, 8, eid="x").e(7, 8, eid="y").e(1, 1, eid="z").graph()
    ids = spark.createDataFrame([(1, 10)], "old_vid long, new_vid long")
    v, e, errors = id_map.renumber(g.v, g.e, ids)
    assert rows(v.select("vid")) == [(10,)] and rows(e.select("eid", "src", "dst")) == [("z", 10, 10)]
    assert rows(errors) == [("edge", "x", "dst"), ("edge", "y", "src,dst"), ("vertex", "2", "vid")]


def test_two_loaders_give_an_id_once(tiny, spark, rows, monkeypatch):
    store = VersionedStore(spark, new_path(spark, "ids"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "vid long")
    commit, raced = store.commit, []

    def late(*args, **kwargs):
        if not raced:
            raced.append(True)
            id_map.allocate(VersionedStore(spark, store.path), ids(2, 4))
        return commit(*args, **kwargs)

    monkeypatch.setattr(store, "commit", late)
    id_map.allocate(store, ids(1, 2, None))
    assert rows(id_map.id_map(store)) == [(1, 3), (2, 1), (4, 2)]


def test_ancestors_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    n, cuts = 1000, []
    v = spark.range(n).withColumnRenamed("id", "vid")
    e = v.where("vid > 0").selectExpr(
        "cast(vid AS string) AS eid", "vid AS src", "vid - 1 AS dst", "'IN' AS contains_other_v")
    monkeypatch.setattr(st, "cut", lambda df, name: cuts.append(name) or storage.cut(df, name))
    up = st.ancestors(v, e)
    assert up.count() == n * (n - 1) // 2 and up.where("vid - ancestor_vid <> depth").isEmpty()
    assert len(cuts) <= 12


def test_alternating_claims_in_few_rounds(tiny, rows, monkeypatch):
    """Rows share the URI with the row before or the uuid with the one after, so that every second one is taken."""
    tiny.type("t", ["id"])
    n, calls = 200, []
    for i in range(n):
        tiny.v(i, "t", uri=f"u{(i + 1) // 2}", uuid=f"x{i // 2}")
    g = tiny.graph()
    one = audit._one_round
    monkeypatch.setattr(audit, "_one_round", lambda left: calls.append(1) or one(left))
    assert rows(audit.accept_vertices(g.v, g.nt).select("vid")) == [(i,) for i in range(0, n, 2)]
    assert len(calls) <= audit.ROUNDS


@pytest.mark.parametrize("component", [0, 5, 1000])
def test_claims_equal_the_greedy_order(tiny, rows, component):
    draw, seen, want = random.Random(5), (set(), set()), []
    tiny.type("t", ["id"])
    for i in range(120):
        pair = f"u{draw.randrange(60)}", f"x{draw.randrange(60)}"
        tiny.v(i, "t", uri=pair[0], uuid=pair[1])
        if pair[0] not in seen[0] and pair[1] not in seen[1]:
            seen[0].add(pair[0]), seen[1].add(pair[1])
            want.append((i,))
    g = tiny.graph()
    assert rows(audit.accept_vertices(g.v, g.nt, rounds=1, component=component).select("vid")) == want
