import pytest
from pyspark.sql import functions as F

from graphwarden.functions.numbering import number_rows
from graphwarden.model import resolve_direction
from graphwarden.operators import migrate, filters, structure as st


def test_window_filters_keep_rows_without_a_time(tiny, rows):
    g = tiny.v(1, "a", mod=100_000).v(2, "a", mod=40_000).v(3, "a").graph()
    assert rows(filters.window_filter_mod(g.v, 160_000, 1).select("vid")) == [(1,), (3,)]
    assert rows(filters.window_filter_created(g.v, 160_000, 1).select("vid")) == [(3,)]
    assert filters.window_filter_mod(g.v, 160_000, 0).count() == 3


def test_prop_filter_needs_a_bar(tiny):
    g = tiny.v(1, "a", x="1", y="2").v(2, "a", x="1").graph()
    assert filters.filter_props(g.v, "x|1,y|2").count() == 1
    with pytest.raises(ValueError):
        filters.filter_props(g.v, "x=1")


def test_lookup_takes_one_to_four_keys(tiny, spark):
    g = tiny.v(1, "a", x="1").v(2, "b", x="1").graph()
    keys = spark.createDataFrame([("1",)], "`key:x` string")
    assert [r.vid for r in filters.lookup_by_keys(g.v, "a", keys).collect()] == [1]
    with pytest.raises(ValueError):
        filters.lookup_by_keys(g.v, "a", keys.toDF("x"))


def test_regex_matches_the_whole_value(tiny, rows):
    g = tiny.v(1, "a", n="ab").v(2, "a", n="abc").graph()
    assert rows(filters.filter_regex(g.v, "a", {"n": "a|ab"}).select("vid")) == [(1,)]


def test_bad_ids_are_reported(tiny, spark, rows):
    g = tiny.v(1, "a", p="x").v(2, "a").graph()
    ids = spark.createDataFrame([("1",), ("2",), ("9",), ("x1",), (" 1 ",)], "id string")
    assert rows(filters.touch_report(g.v, ids, "p")) == [
        ("1", "updatable"), ("2", "no_property"), ("9", "not_found"), ("x1", "bad_id")]


def test_tree_follows_the_containment_property(tiny, rows):
    g = tiny.e(1, 2, contains="OUT").e(3, 4, contains="IN").e(5, 6).graph()
    assert rows(st.tree(g.e).select("parent_vid", "child_vid")) == [(1, 2), (4, 3)]


def test_descendants_count_walks(tiny, spark, rows):
    # a diamond counts twice, a cycle stops at the depth limit
    g = tiny.e(1, 2, contains="OUT").e(1, 3, contains="OUT").e(2, 4, contains="OUT").e(3, 4, contains="OUT").e(
        7, 8, contains="OUT").e(8, 7, contains="OUT").graph()
    ids = spark.createDataFrame([(1,), (7,), (4,)], "vid long")
    assert rows(st.count_descendants(g.e, ids)) == [(1, 4), (4, 0), (7, 15)]


def test_self_loop_counts_twice(tiny, spark, rows):
    g = tiny.e(1, 1).e(1, 2).graph()
    assert rows(st.count_edges(g.e, spark.createDataFrame([(1,), (3,)], "vid long"))) == [(1, 3), (3, 0)]


def test_ancestors_and_has_edge(tiny, spark, rows):
    g = tiny.v(3, "x").e(1, 2, contains="OUT").e(2, 3, contains="OUT").graph()
    assert rows(st.ancestors(g.v, g.e).select("vid", "depth", "ancestor_vid")) == [(3, 1, 2), (3, 2, 1)]
    pairs = spark.createDataFrame([(2, 1), (1, 2)], "a long, b long")
    assert rows(st.has_edge(pairs, g.e, "OUT")) == [(1, 2)]


def test_walks_have_no_depth_limit_and_end_in_cycles(tiny, spark, rows):
    tiny.type("n", ["id"], template="/n/{id}").type("top", ["id"], top=True, template="/top/{id}")
    for i in range(1, 21):
        tiny.v(i, "n" if i > 1 else "top", id=i)
        if i > 1:
            tiny.e(i - 1, i, contains="OUT")
    g = tiny.graph()
    out, visited = migrate.rebuild_uris(g.v, g.e, g.nt)
    assert visited.count() == 20
    assert out.where("vid = 20").first().uri == "/top/1" + "".join(f"/n/{k}" for k in range(2, 21))
    g = tiny.e(20, 1, contains="OUT").graph()  # the end holds the start
    up = st.ancestors(g.v, g.e)
    assert rows(up.where("vid = 20").select("depth", "ancestor_vid")) == [(k, 20 - k) for k in range(1, 20)]
    assert up.count() == 20 * 19
    assert migrate.rebuild_uris(g.v, g.e, g.nt)[1].count() == 20
    assert rows(st.count_descendants(g.e, g.v.where("vid = 3"))) == [(3, 15)]


def test_merge_reaches_the_last_level(tiny, spark, rows):
    tiny.type("n", ["id"])
    for side in (0, 100):
        for i in range(1, 21):
            tiny.v(side + i, "n", id=i if i > 1 else side)
            if i > 1:
                tiny.e(side + i - 1, side + i, contains="OUT")
    g = tiny.graph()
    pairs = spark.createDataFrame([(101, 1)], "secondary long, primary long")
    assert rows(migrate.merge_map(g.v, g.e, g.nt, pairs)) == [(100 + i, i) for i in range(1, 21)]


def test_edge_report_names_vertices_without_uri(tiny, rows):
    g = tiny.v(1, "a", uri="").v(2, "b").e(1, 2).graph()
    report, bare = st.edge_report(g.v, g.e)
    assert [r.line for r in report.collect()] == ["1-a|L|/2|NONE"]
    assert rows(bare) == [(1, "a")]


def test_numbering_is_dense_with_one_hot_value(spark):
    df = spark.range(2000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"))
    got = [r.rn for r in number_rows(df, ["k"]).orderBy("rn").collect()]
    assert got == list(range(1, 2001))


def test_direction_placeholders():
    assert resolve_direction({"direction": "OUT", "c": "!${direction}", "d": "${direction}", "e": "NONE"}) == {
        "direction": "OUT", "c": "IN", "d": "OUT", "e": "NONE"}


def test_release_deletes_the_session_folder(spark, monkeypatch, tmp_path):
    from graphwarden.functions import storage
    monkeypatch.setattr(storage, "_session_dirs", {})
    monkeypatch.setattr(storage, "work_dir", lambda _: str(tmp_path))
    assert storage.cut(spark.range(5)).count() == 5
    assert len(list(tmp_path.iterdir())) == 1
    storage.release(spark)
    assert not list(tmp_path.iterdir())
