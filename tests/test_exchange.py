import json

from graphwarden.operators import payload, traverse as tr
from graphwarden.sources import feeds


def network(tiny):
    return (tiny.rule("region", "tenant", "L", contains="OUT").rule("tenant", "server", "M")
            .v(1, "region", id="r").v(2, "tenant", id="a").v(3, "tenant", id="b").v(4, "server", id="s").v(5, "server", id="t")
            .e(1, 2, contains="OUT").e(1, 3, contains="OUT").e(2, 4, "M").e(3, 4, "M").e(3, 5, "M").e(3, 5, "N").graph())


def test_traversal(tiny, rows):
    g = network(tiny)
    q = tr.seed(g, "region").to("tenant").to("server")
    assert rows(q.result()) == [(4,), (4,), (5,)]
    assert q.count().first().n == 3
    assert rows(q.limit(2).result()) == [(4,), (4,)]
    assert rows(tr.seed(g, "tenant").has("id", "b").to("region").result()) == [(1,)]
    assert rows(tr.seed(g, "tenant").has_not("id", "b").result()) == [(2,)]
    assert rows(tr.seed(g, "tenant").where(lambda t: t.to("server").has("id", "t")).result()) == [(3,)]
    assert rows(tr.seed(g, "tenant").union(lambda t: t.to("region"), lambda t: t.to("server")).result()) == [
        (1,), (1,), (4,), (4,), (5,)]
    walks = tr.seed(g, "tenant").to("region").to("tenant").to("server")
    assert rows(walks.rows().select("vid", "n")) == [(4, 4), (5, 2)]  # a row per vertex, whatever the number of walks
    assert rows(tr.seed(g, "region").where(lambda t: t.to("tenant").where(lambda u: u.to("server").has("id", "t"))).result()) == [(1,)]
    assert rows(tr.seed(g, "tenant").where(lambda t: t.union(lambda u: u.has("id", "zz"), lambda u: u.to("server").has("id", "t"))).result()) == [(3,)]
    assert rows(tr.seed(g, "region").store().to("tenant").to("server").store().limit(2).result()) == [(1,), (4,)]
    assert tr.seed(g, "region").store().to("tenant").store().limit(2).count().first().n == 2
    assert rows(tr.seed(g, "region").store().to("tenant").to("server").store().result()) == [(1,), (4,), (5,)]


def test_booleans_and_many_copies(tiny, rows):
    g = tiny.v(1, "a", flag="true").v(2, "a", flag="false").v(3, "a").graph()
    assert rows(tr.seed(g, "a").has("flag", True).result()) == [(1,)]
    assert rows(tr.seed(g, "a").has_not("flag", True).result()) == [(2,), (3,)]
    q = tr.replace(tr.seed(g, "a"), frontier=g.v.selectExpr("vid", "vid * 1500 AS n"))
    assert rows(q.result().groupBy("vid").count()) == [(1, 1500), (2, 3000), (3, 4500)]


def test_subgraphs(tiny, spark, rows):
    g = network(tiny)
    ids = spark.createDataFrame([(2,), (4,), (1,)], "vid long")
    v, e = tr.subgraph(g, ids, "star")
    assert (v.count(), e.count()) == (4, 4)
    v, e = tr.subgraph(g, ids, "prune")
    assert rows(v.select("vid")) == [(1,), (2,), (4,)] and e.count() == 2
    v, e = tr.subgraph(g, spark.createDataFrame([(1,), (5,)], "vid long"), "prune")
    assert v.isEmpty() and e.isEmpty()


def documents(pieces):
    docs = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_vid, r.path)):
        docs[r.doc_vid] = docs.get(r.doc_vid, "") + r.text
    return {k: json.loads(t) for k, t in docs.items()}


def test_payload_nests(tiny, spark):
    t = tiny.v(1, "region", id="r").v(50, "zone").e(1, 50, contains="OUT").v(51, "rack").e(50, 51, contains="OUT")
    for i in range(2, 5):
        t.v(i, "tenant", uri=f"/t{i}", id=i).e(1, i, contains="OUT").v(i * 10, "server", id='x"y').e(i, i * 10, contains="OUT")
    g = t.v(99, "far", uri="/far").e(2, 99).e(2, 99).e(4, 30, contains="OUT").graph()
    docs = documents(payload.build_payload(g.v, g.e, g.v.where("vid IN (1, 4)"), ["far"], ["region"]))
    server = {"id": 'x"y', "resource-version": "1"}
    up = {"relationship": [{"related-to": "region", "related-link": "/1"}]}
    assert docs[1] == {"id": "r", "tenant": [
        {"id": "2", "resource-version": "1", "server": [server], "relationship-list": {
            "relationship": [{"related-to": "far", "related-link": "/far"}, {"related-to": "region", "related-link": "/1"}]}},
        {"id": "3", "resource-version": "1", "server": [server], "relationship-list": up},
        {"id": "4", "resource-version": "1", "server": [server, server], "relationship-list": up}],
        "zone": [{"resource-version": "1", "rack": [{"resource-version": "1"}], "relationship-list": up}]}
    assert docs[4] == {"id": "4", "server": [server, server], "relationship-list": up}
    lines = [r.text for r in payload.payload_lines(payload.build_payload(g.v, g.e, g.v.where("vid = 1"))).collect()]
    assert json.loads("".join(lines))["tenant"][2]["server"] == [server, server]
    bare = payload.build_payload(g.v, g.e, g.v.where("vid = 50"))
    assert documents(bare) == {50: {"rack": [{"resource-version": "1"}]}}


def test_payload_depth_and_cycles(tiny):
    for i in range(1, 21):
        tiny.v(i, f"n{i:02}", id=i)
        if i > 1:
            tiny.e(i - 1, i, contains="OUT")
    g = tiny.e(20, 1, contains="OUT").graph()
    doc, depth = documents(payload.build_payload(g.v, g.e, g.v.where("vid = 1")))[1], 1
    while kids := [x for x in doc.values() if isinstance(x, list)]:
        doc, depth = kids[0][0], depth + 1
    assert depth == 20
    assert payload.build_events(g.v, g.e, g.v.where("vid = 20"), "h/", "v1").first().top_type == "n01"


def test_events_nest_up_to_the_top(tiny):
    g = (tiny.v(1, "region", id="r").v(2, "tenant", uri="/r/t", id="t").e(1, 2, contains="OUT").graph())
    r = payload.build_events(g.v, g.e, g.v.where("vid = 2"), "http://h/", "v1").first()
    event = json.loads(r.event)
    assert event["entity"] == {"id": "r", "tenant": [{"id": "t"}]}
    assert (event["event-header"]["entity-link"], event["event-header"]["top-entity-type"]) == ("http://h/v1/r/t", "region")


def test_events_follow_one_chain(tiny):
    """The lowest parent counts, then that parent's own parent, not the lowest vertex of each level."""
    g = (tiny.v(20, "a", id="a20").v(30, "a", id="a30").v(11, "b", id="b11").v(12, "b", id="b12").v(5, "c", id="c")
         .e(30, 11, contains="OUT").e(20, 12, contains="OUT").e(11, 5, contains="OUT").e(12, 5, contains="OUT").graph())
    event = json.loads(payload.build_events(g.v, g.e, g.v.where("vid = 5"), "h/", "v1").first().event)
    assert event["entity"] == {"id": "a30", "b": [{"id": "b11", "c": [{"id": "c"}]}]}


def test_notifications(tiny, spark, rows):
    g = tiny.v(1, "a", version="7").v(2, "a", version="8").v(3, "b", version="1").graph()
    lines = spark.createDataFrame([("10_1_6",), ("30_1_7",), ("20_2_8",), ("5_2_9",), ("1_3_1",), ("junk",), ("1_9_1",)], "value string")
    got = payload.notify_changes(payload.parse_event_lines(lines), g.v, ["a"], 1)
    assert rows(got.select("vid", "batch")) == [(1, 1), (2, 0)] or rows(got.select("vid", "batch")) == [(1, 0), (2, 1)]
    dels = spark.createDataFrame([("a#@#/u#@#{}",), ("a#@#/u",), ("x",)], "value string")
    assert rows(payload.notify_deletes(dels)) == [("a", "/u", "{}")]


def test_resend(tiny, spark, rows):
    g = tiny.v(1, "a", uri="/a/1", version="5").v(2, "a", uri="/a/2", version="5").v(3, "a", uri="/a/2", version="5").graph()
    ev = spark.createDataFrame(
        [(1, "/x/v9/a/1", "UPDATE", ["4", "5"]), (2, "/x/v9/a/1", "UPDATE", ["5", "6"]), (3, "/x/v9/a/9", "DELETE", ["1"]),
         (4, "/x/v9/a/9", "UPDATE", ["1"]), (5, "/x/v9/a/1", "UPDATE", []), (6, "/x/v9/a/2", "UPDATE", ["5"])],
        "id int, entity_link string, action string, versions array<string>")
    assert rows(payload.resend_filter(ev, g.v).select("id")) == [(1,), (3,)]
    assert payload.resend_filter(ev, g.v, check=False).count() == 6


def test_snapshot_choice(spark):
    make = lambda x: spark.createDataFrame(x, "name string, modified long")
    assert payload.pick_snapshot(make([("a", 1)])).first().name == "a"
    assert payload.pick_snapshot(make([("a", 1), ("b", 2), ("c", 3)])).first().name == "b"
    one = [("d/dataSnapshot.graphSON.201801010101.P0", 1), ("d/dataSnapshot.graphSON.201801010101.P1", 2)]
    assert payload.pick_snapshot_set(make(one)).isEmpty()
    two = one + [("d/dataSnapshot.graphSON.201901010101.P0", 0)]
    assert payload.pick_snapshot_set(make(two)).first().name == "d/dataSnapshot.graphSON.201801010101"


def test_feed_fields(spark, rows):
    lines = spark.createDataFrame([("a, b",), (' "x y" , 2 ',), ("1",), ("",), (",3",)], "value string")
    good, bad = feeds.parse_feed(lines, {"a": 0, "b": 1}, 2, "a,b")
    assert rows(good) == [("x y", "2")]
    assert rows(bad) == [(",3", "empty field"), ("1", "width")]


def test_models_are_loaded_once(tiny, spark, rows):
    g = tiny.v(1, "root").v(2, "model", model_invariant_id="i1").graph()
    lines = spark.createDataFrame(
        [("X.model-invariant-id.a = i1",), ("X.model-version-id.a=v1",), ("X.model-invariant-id.b=i2",), ("# c",), ("bad=1",)], "value string")
    props = feeds.parse_properties(lines)
    v, e = feeds.load_root_models(props, g.v, g.e, 1, 100, 5)
    assert rows(v.select("vid", "node_type")) == [(101, "model-ver")]
    assert rows(e.select("src", "dst", "label")) == [(1, 2, "models"), (2, 101, "model-vers")]
    v2, e2 = feeds.load_root_models(props, g.v.unionByName(v), g.e.unionByName(e), 1, 100, 5)
    assert v2.isEmpty() and e2.isEmpty()
