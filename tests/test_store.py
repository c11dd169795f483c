import pytest

from graphwarden.operators import audit, history, schema_ops
from graphwarden.sources import snapshot as snap

DAY = history.DAY_MS


def test_history_windows(tiny):
    """2 current vertices, 2 that ended 7 days ago and 7 that ended 30 days ago."""
    now, t = 100 * DAY, tiny
    for i, ago in enumerate([None] * 2 + [7] * 2 + [30] * 7):
        t.v(i, "x", end_ts=None if ago is None else now - ago * DAY)
    g = t.e(0, 5, end_ts=None).e(0, 1, end_ts=now - 90 * DAY).graph()
    counts = [history.truncate_counts(g.v, g.e, history.history_cutoff(now, d)).first().n_vertices for d in (0, 5, 10, 40)]
    assert counts == [9, 9, 7, 0]
    v, e, log = history.truncate_history(g.v, g.e, history.history_cutoff(now, 10), history.DELETE_AND_LOG)
    assert (v.count(), e.count(), log.count()) == (4, 0, 8)
    v, e, log = history.truncate_history(g.v, g.e, history.history_cutoff(now, 10))
    assert (v.count(), e.count(), log.count()) == (11, 2, 8)
    assert history.truncate_history(g.v, g.e, 0, history.SILENT_DELETE)[2].isEmpty()


@pytest.mark.parametrize("n, threads, per_file, want", [
    (100, 10, 50, 10), (1000, 10, 10, 100), (1001, 10, 10, 110), (0, 10, 10, 1), (5, 0, 10, 1), (5, 10, 0, 1)])
def test_file_count(n, threads, per_file, want):
    assert snap.snapshot_file_count(n, threads, per_file) == want


def test_accept_is_greedy(tiny, rows):
    """(u1,x), (u2,x), (u2,y): the second is rejected and so does not block the third."""
    g = (tiny.type("t", ["id"]).v(1, "t", uri="u1", uuid="x").v(2, "t", uri="u2", uuid="x").v(3, "t", uri="u2", uuid="y")
         .v(4, "other", uri="u4").v(5, "t", uri="").graph())
    assert rows(audit.accept_vertices(g.v, g.nt).select("vid")) == [(1,), (3,)]


def test_count_comparison(spark, rows):
    make = lambda x: spark.createDataFrame(x, "table_name string, n long")
    got = audit.compare_counts(make([("a", 1), ("b", 2), ("c", 3)]), make([("a", 1), ("b", 0), ("d", 4)]))
    assert rows(got.select("table_name", "status")) == [
        ("a", "equal"), ("b", "zero in right"), ("c", "only in left"), ("d", "only in right")]


def test_snapshot_time_needs_twelve_digits(spark):
    df = spark.createDataFrame([("s.graphson.201811291515",), ("s.2018112915150",), ("s",)], "n string")
    got = [str(r[0]) for r in df.select(audit.snapshot_ts(df.n)).collect()]
    assert got == ["2018-11-29 15:15:00", "None", "None"]


def test_retype(tiny, rows):
    g = tiny.v(1, "a", p="7").v(2, "a", p="x").v(3, "a").v(4, "a", p="7").graph()
    with pytest.raises(schema_ops.NotUnique):
        schema_ops.retype_property(g.v, "p", "Integer", unique=True)
    v, failed = schema_ops.retype_property(g.v, "p", "Integer", date="D")
    assert rows(failed) == [(2, "x")]
    assert {r.vid: r.props for r in v.collect()} == {1: {"p": "7"}, 2: {"p-D-RETIRED": "x"}, 3: {}, 4: {"p": "7"}}
    v, _ = schema_ops.retype_property(g.v, "p", "Integer", preserve=False)
    assert all("p" not in r.props for r in v.collect())


def test_snapshot_round_trip(tiny, spark, tmp_path, rows):
    """A hub and a leaf have the same layout, a line for the vertex and one for each end of an edge, and come back whole."""
    t = tiny.v(1, "hub", id='q"uote', created="x", mod=5)
    for i in range(2, 22):
        t.v(i, "x", end_ts=i).e(1, i, label="A" if i % 2 else "B", contains="OUT", end_ts=i, weight=i)
    g = t.graph()
    lines = snap.snapshot_lines(g.v, g.e, "inv-")
    assert lines.count() == 21 + 2 * 20
    path = str(tmp_path / "s")
    lines.write.text(path)
    v, e = snap.read_snapshot(spark, path, "inv-")
    flat = lambda df: sorted(str(r.asDict()) for r in df.collect())
    assert flat(v.select(*g.v.columns)) == flat(g.v)
    assert flat(e.select(*g.e.columns)) == flat(g.e)
    assert rows(snap.read_partial_snapshot(spark, path, "inv-")[1].select("eid")) == rows(e.select("eid"))


def test_unreadable_lines_are_error_rows(spark, tmp_path, rows):
    (tmp_path / "s").write_text('{"id":1,"label":"vertex"}\n{"id":2,"lab\n\nplain text\n')
    path = str(tmp_path / "s")
    assert rows(snap.unreadable_lines(spark, path)) == [("plain text", "unreadable"), ('{"id":2,"lab', "unreadable")]
    v, e, errors = snap.load_snapshot(spark, path, max_errors=2)
    assert (v.count(), e.count(), errors.count()) == (1, 0, 2)
    with pytest.raises(snap.LoadFailed):
        snap.load_snapshot(spark, path, max_errors=1)


def test_schema_diff_sees_cardinality(tiny, spark, rows):
    g = tiny.v(1, "a", one='["x","y"]', many='["x"]').v(2, "a", one="x", many="y", size="4").graph()
    expected = spark.createDataFrame([("one", "String", "SINGLE"), ("many", "String", "SET"), ("size", "Integer", "SINGLE")],
                                     "name string, type string, cardinality string")
    assert rows(schema_ops.schema_diff(g.v, expected).select("name", "status")) == [("many", "ok"), ("one", "changed"), ("size", "ok")]


def test_snapshot_value_types_and_part_files(spark, tmp_path):
    line = ('{"id":%d,"label":"vertex","properties":{"n":[{"id":"a","value":%s}],'
            '"tags":[{"id":"b","value":"x"},{"id":"c","value":"y"}]}}')
    for i, value in enumerate(["12", "true", '"s"']):
        (tmp_path / f"snap.P{i}").write_text(line % (i, value))
    v, _ = snap.read_snapshot(spark, str(tmp_path / "snap"))
    assert {r.vid: (r.props["n"], r.props["tags"]) for r in v.collect()} == {
        0: ("12", '["x","y"]'), 1: ("true", '["x","y"]'), 2: ("s", '["x","y"]')}


def test_reload_reports_unmapped_ends(tiny, rows):
    g = tiny.v(1, "a").v(2, "a").e(1, 2, eid="ok").e(2, 9, eid="bad").graph()
    v, e, id_map, errors = snap.reload_with_new_ids(g.v, g.e, 100)
    assert rows(e.select("eid", "src", "dst")) == [("ok", 101, 102)]
    assert rows(errors) == [("bad", 2, 9, "dst")]
    snap.check_error_budget(errors, 1)
    with pytest.raises(snap.LoadFailed):
        snap.check_error_budget(errors, 0)


def test_history_init_sources(tiny, rows):
    g = tiny.type("t", ["id"]).v(1, "t", source="SRC", id="k", other="o").graph()
    props, _ = snap.load_history_init(g.v, g.e, g.nt, 7)
    got = {r.key: r.source_of_truth for r in props.collect()}
    assert {k for k, s in got.items() if s == "SRC"} == {"id", "node-type", "uri", "source-of-truth", "start-ts"}
    assert got["other"] == "N/A"
