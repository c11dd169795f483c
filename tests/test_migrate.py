import pytest
from pyspark.sql import functions as F

from graphwarden.operators import migrate
from graphwarden.recipes import feeds, models, servers, values


def props(df, *names):
    return {r.vid: tuple(r.props.get(n) for n in names) for r in df.collect()}


def test_fill_values(tiny):
    g = tiny.v(1, "a", p="x").v(2, "a", p="").v(3, "a").v(4, "b").v(5, "a", k="yes").graph()
    v, changed = migrate.fill_values(g.v, {"a": {"p": "d"}})
    assert props(v, "p") == {1: ("x",), 2: ("d",), 3: ("d",), 4: (None,), 5: ("d",)}
    assert changed.count() == 3
    v, _ = migrate.fill_values(g.v, {"a": {"p": "d"}}, {"k": ["yes"]})
    assert props(v, "p")[5] == ("d",) and props(v, "p")[3] == (None,)
    v, _ = migrate.fill_values(g.v, {"a": {"p": "d"}}, None, True)
    assert props(v, "p")[1] == ("d",)


def test_rename(tiny):
    g = tiny.v(1, "a", old="x").v(2, "b", old="y").graph()
    v, changed = migrate.rename_property(g.v, "old", "new", ["a"])
    assert props(v, "old", "new") == {1: (None, "x"), 2: ("y", None)}
    assert [r.vid for r in changed.collect()] == [1]


def test_swing_keeps_direction_and_properties(tiny, spark, rows):
    g = (tiny.v(1, "s").v(2, "s").v(3, "x").v(4, "y").v(5, "other")
         .e(1, 3, eid="a", w="1").e(4, 1, eid="b").e(2, 3, eid="c").e(1, 4, eid="d").graph())
    pairs = spark.createDataFrame([(1, 2), (1, 5)], "old long, new long")
    e, moved = migrate.swing_edges(g.e, g.v, pairs)
    # 2 had 3 already; 5 is of another type
    assert rows(e.select("eid", "src", "dst")) == [("c", 2, 3), ("swung:b", 4, 2), ("swung:d", 2, 4)]
    e, _ = migrate.swing_edges(g.e, g.v, pairs, other_type="y", direction="OUT")
    assert rows(e.select("eid")) == [("a",), ("b",), ("c",), ("swung:d",)]
    with pytest.raises(ValueError):
        migrate.swing_edges(g.e, g.v, pairs, direction="UP")


def test_several_old_vertices_bring_a_neighbour_once(tiny, spark, rows):
    g = tiny.v(1, "s").v(2, "s").v(3, "s").v(9, "x").e(1, 9, eid="a").e(2, 9, eid="b").graph()
    pairs = spark.createDataFrame([(1, 3), (2, 3)], "old long, new long")
    assert rows(migrate.swing_edges(g.e, g.v, pairs)[0].select("eid")) == [("swung:a",)]


def test_merge_is_recursive_and_keeps_cousins(tiny, spark, rows):
    g = (tiny.type("box", ["id"], top=True, lists=["tags"]).type("port", ["name"], ["box"]).type("sub", ["name"], ["port"])
         .v(1, "box", id="a", keep="1", tags='["x"]').v(2, "box", id="b", keep="2", only="2", forced="2", tags='["y","x"]')
         .v(11, "port", name="p").v(21, "port", name="p", speed="9").v(22, "port", name="q")
         .v(31, "sub", name="s").v(41, "sub", name="s").v(42, "sub", name="t").v(50, "far").v(51, "far")
         .e(1, 11, contains="OUT").e(2, 21, contains="OUT").e(2, 22, contains="OUT")
         .e(11, 31, contains="OUT").e(21, 41, contains="OUT").e(21, 42, contains="OUT")
         .e(1, 50).e(2, 50).e(51, 2).e(41, 51).graph())
    pairs = spark.createDataFrame([(1, 2)], "primary long, secondary long")
    v, e, m = migrate.merge_vertices(g.v, g.e, g.nt, pairs, {"box": ["keep"]})
    assert rows(m.select("secondary", "primary")) == [(2, 1), (21, 11), (41, 31)]
    assert props(v, "keep", "only", "tags")[1] == ("2", "2", '["x","y"]')
    assert props(v, "speed")[11] == ("9",)
    assert rows(e.select("src", "dst")) == [(1, 11), (1, 22), (1, 50), (11, 31), (11, 42), (31, 51), (51, 1)]


def test_reset_and_create_edges(tiny, spark, rows):
    g = (tiny.rule("a", "b", "L", contains="OUT", delete="OUT").rule("a", "c", "M")
         .v(1, "a").v(2, "b").v(3, "c").e(1, 2, eid="known", x="1").e(1, 2, label="Z", eid="unknown").graph())
    e, unknown = migrate.reset_edge_props(g.e, g.v, [("b", "a")], g.rules)
    got = {r.eid: (r.contains_other_v, r.delete_other_v, r.props) for r in e.collect()}
    assert got == {"known": ("OUT", "OUT", {}), "unknown": ("NONE", "NONE", {})}
    assert rows(unknown) == [("unknown",)]
    pairs = spark.createDataFrame([(3, 1), (2, 3), (2, 1)], "a long, b long")
    made, no_rule = migrate.create_edges(pairs, g.v, g.e, g.rules)
    assert rows(made.select("src", "dst", "label")) == [(1, 3, "M")]
    assert rows(no_rule) == [(2, 1), (2, 3)]
    made, _ = migrate.create_edges(pairs, g.v, g.e, g.rules, migrate.TREE)
    assert made.isEmpty()


def test_rebuild_edges_reports_multiplicity(tiny, rows):
    g = (tiny.rule("a", "b", "New", multiplicity="MANY2ONE", prevent="IN")
         .v(1, "a").v(2, "b").v(3, "b").v(4, "c").e(1, 2, eid="e1", label="Old").e(3, 1, eid="e2", label="Old")
         .e(1, 4, eid="e3").e(1, 9, eid="e4").graph())
    e, report = migrate.rebuild_edges(g.e, g.v, g.rules)
    assert rows(e.select("eid", "src", "dst", "label", "prevent_delete")) == [("e1", 1, 2, "New", "IN")]
    assert rows(report) == [("e2", "multiplicity"), ("e3", "no rule"), ("e4", "missing end")]


def test_uris_from_the_top(tiny, rows):
    g = (tiny.type("top", ["id"], top=True, template="/tops/top/{id}").type("kid", ["a", "b"], ["top"], template="/kids/kid/{a}/{b}")
         .v(1, "top", id="x y").v(2, "kid", a="1/2", b="b").v(3, "kid", a="1").v(4, "kid", a="deep", b="d").v(5, "kid", a="o", b="o")
         .e(2, 1, contains="IN").e(3, 1, contains="IN").e(3, 4, contains="OUT").e(1, 2, contains="OUT").graph())
    v, _ = migrate.rebuild_uris(g.v, g.e, g.nt)
    assert dict(rows(v.select("vid", "uri"))) == {
        1: "/tops/top/x%20y", 2: "/tops/top/x%20y/kids/kid/1%2F2/b", 3: "/3", 4: "/4", 5: "/5"}


def test_ledger(tiny, spark, rows):
    g = tiny.v(1, "a").graph()
    seen = []

    def make(name, status=migrate.SUCCESS):
        def run(graph):
            seen.append(name)
            v, changed = migrate.fill_values(graph.v, {"a": {name: "1"}})
            return migrate.Outcome(v, graph.e, changed, changed.select(F.lit("7").alias("line"), F.lit("why").alias("reason")), status)
        return run

    reg = [migrate.Migration("b", make("b"), 2), migrate.Migration("a", make("a"), 1), migrate.Migration("bad", make("bad", migrate.FAILURE), 3),
           migrate.Migration("off", make("off"), 0, False), migrate.Migration("old", make("old"), 4)]
    ledger = spark.createDataFrame([("old",)], "name string")
    g1, l1, summary, out = migrate.run_migrations(spark, g, reg, ledger, migrate.Options(commit=True, now_ms=77))
    assert seen == ["a", "b", "bad"]
    assert g1.e is g.e  # untouched tables are not written again
    assert (g1.v.first().last_mod_ts, g1.v.first().resource_version) == (77, "77")
    assert [rows(o.events) for _, o in out[:2]] == [[(77, g1.v.first().vid, "77")]] * 2
    assert out[0][1].deletes.isEmpty() and out[2][1].events is None
    assert g1.v.first().props == {"a": "1", "b": "1"}
    assert rows(l1) == [("a",), ("b",), ("old",)]
    assert dict(r[1:] for r in rows(summary)) == {
        "off": "disabled", "a": "committed", "b": "committed", "bad": "failed, rolled back", "old": "already run"}
    assert rows(migrate.migration_summary(spark, out))[0] == ("a", "SUCCESS", 1, 1)
    assert migrate.fallout_rows(out).count() == 3
    seen.clear()
    g2, l2, _, _ = migrate.run_migrations(spark, g, reg, ledger, migrate.Options(include=["off", "old"], run_disabled=["off"], forced=True))
    assert seen == ["off", "old"] and g2.v.first().props == {} and rows(l2) == [("old",)]


def test_link_names(spark):
    df = spark.createDataFrame([("b:1|a:2",), ("a:1|b:2",), ("plain",)], "n string")
    assert [r[0] for r in df.select(values.canonical_link_name(F.col("n"))).collect()] == ["a:2|b:1", "a:1|b:2", "plain"]


def test_same_source_keeps_newest_and_first_on_a_draw(tiny, rows):
    t = tiny
    for vid, version, fqdn in [(1, "5", "h.a"), (2, "9", "h.b"), (3, "9", "h.c"), (4, "1", "k.a"), (5, "1", None)]:
        t.v(vid, "pserver", version=version, source="SRC-A", hostname=f"n{vid}", **({"fqdn": fqdn} if fqdn else {}))
    g = t.graph()
    assert rows(servers.same_source_pairs(g.v, ["SRC-A"], "version")) == [(1, 2), (3, 2)]


def test_widget_versions(tiny, spark, rows):
    g = (tiny.v(1, "model", model_invariant_id="good", model_type="widget").v(2, "model-ver", model_version_id="gv", model_name="n")
         .v(3, "model", model_invariant_id="bad", model_type="widget").v(4, "model-ver", model_version_id="bv", model_name="n")
         .v(5, "element").v(6, "named-query-element")
         .e(2, 1, "BelongsTo").e(4, 3, "BelongsTo").e(5, 4, "IsA").e(6, 3, "IsA").graph())
    valid = spark.createDataFrame([("n", "gv", "good")], "name string, version_id string, invariant_id string")
    one = models.swing_bad_models(g, valid)
    assert rows(one.e.where("label = 'IsA'").select("src", "dst")) == [(5, 4), (6, 1)]
    # the model still holds a named-query element before part one, so its version stays
    two = models.swing_bad_versions(g, valid)
    assert 4 in {r.vid for r in two.v.collect()}
    from graphwarden.model import Graph
    two = models.swing_bad_versions(Graph(g.v, one.e, g.nt, g.rules), valid)
    assert rows(two.v.select("vid")) == [(1,), (2,), (5,), (6,)]
    assert rows(two.e.select("src", "dst")) == [(2, 1), (5, 2), (6, 1)]


def test_inventory_feed_creates_what_is_missing(tiny, spark, rows):
    g = (tiny.v(1, "pnf", uri="/network/pnfs/pnf/a", pnf_name="a").v(2, "p-interface", interface_name="1").e(2, 1, "BindsTo", "IN").graph())
    feed = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"), ("", "3")], "pnf string, port string")
    out = feeds.physical_inventory(g, feed)
    assert rows(out.v.select("vid", "node_type", "uri").where("vid > 2")) == [
        (3, "pnf", "/network/pnfs/pnf/b"), (4, "p-interface", "/network/pnfs/pnf/a/p-interfaces/p-interface/2"),
        (5, "p-interface", "/network/pnfs/pnf/b/p-interfaces/p-interface/1")]
    assert rows(out.e.select("src", "dst")) == [(2, 1), (4, 1), (5, 3)]
    again = feeds.physical_inventory(type(g)(out.v, out.e, g.nt, g.rules), feed)
    assert again.changed.isEmpty()


def test_module_versions_are_searched_level_by_level(tiny, rows):
    g = (tiny.v(1, "model-ver", model_version_id="top", model_name="top").v(2, "model-element").v(3, "model-element")
         .v(4, "model-ver", model_version_id="deep", model_name="m").v(5, "model", model_invariant_id="i")
         .e(2, 1, "BelongsTo").e(3, 2, "BelongsTo").e(3, 4, "IsA").e(4, 5, "BelongsTo").graph())
    from graphwarden.recipes.common import Labels
    found = models.model_elements_below(g, g.v.where("vid = 1").select("vid"), Labels())
    assert rows(found.select("start", "name", "ver", "inv")) == [(1, "m", "deep", "i")]


def test_merge_targets_of_chains_and_cycles(spark, rows):
    pairs = [(k, k - 1) for k in range(101, 400)]  # a chain of 300
    pairs += [(1, 2), (2, 3), (3, 1)]  # a cycle: the lowest stays
    pairs += [(10, 11), (10, 12), (13, 12)]  # gone into two: the lower of those that stay
    pairs += [(20, 20), (None, 21), (22, None)]
    df = spark.createDataFrame(pairs, "secondary long, primary long")
    want = [(k, 100) for k in range(101, 400)] + [(2, 1), (3, 1), (10, 11), (12, 11), (13, 11)]
    assert rows(migrate.merge_targets(df)) == sorted(want)
    assert migrate.merge_targets(df.limit(0)).count() == 0


def test_merge_over_a_chain(tiny, rows):
    t = tiny.type("s", ["id"], top=True)
    for k in range(1, 5):
        t.v(k, "s", id=k, **{f"p{k}": k}).v(k + 10, "far").e(k, k + 10)
    g = t.graph()
    v, e, m = migrate.merge_vertices(g.v, g.e, g.nt, tiny.spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "secondary long, primary long"))
    assert rows(m) == [(2, 1), (3, 1), (4, 1)]
    assert {r.vid: r.props for r in v.where("node_type = 's'").collect()} == {1: {"id": "1", "p1": "1", "p2": "2", "p3": "3", "p4": "4"}}
    assert rows(e.select("src", "dst")) == [(1, k + 10) for k in range(1, 5)]
