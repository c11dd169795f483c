"""What the derived graph and its files take on disk and in a task."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from graphwarden.functions.storage import cut, new_path, watched
from graphwarden.functions.versions import VersionedStore
from graphwarden.model import Graph
from graphwarden.operators import audit, groom, migrate, payload, repair
from graphwarden.sources import bucketed, id_map, snapshot as snap, tables

N = 400
TABLES = {
    "region": "SELECT 0 r_regionkey, 'R' r_name",
    "nation": "SELECT 0 n_nationkey, 'N' n_name, 0 n_regionkey",
    "customer": "SELECT id c_custkey, concat('c', id) c_name, 0 c_nationkey, 1D c_acctbal, 'BUILDING' c_mktsegment FROM range(5)",
    "supplier": "SELECT id s_suppkey, concat('s', id) s_name, 0 s_nationkey, 1D s_acctbal FROM range(3)",
    "part": "SELECT id p_partkey, 'p' p_name, 'B' p_brand, 'T' p_type, 1 p_size, 1D p_retailprice FROM range(90)",
    "orders": """SELECT id o_orderkey, id % 5 o_custkey, 'F' o_orderstatus, 1D o_totalprice, TIMESTAMP '2020-01-01' o_orderdate,
        '1-URGENT' o_orderpriority FROM range(200)""",
    "lineitem": f"""SELECT id % 200 l_orderkey, id % 90 l_partkey, id % 3 l_suppkey, CAST(id / 200 AS INT) l_linenumber, 1D l_quantity,
        1D l_extendedprice, 0D l_discount, 0D l_tax, 'A' l_returnflag, 'F' l_linestatus, TIMESTAMP '2020-01-01' l_shipdate FROM range({N})""",
}


@pytest.fixture
def sf(spark, tmp_path):
    for name, text in TABLES.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_line_is_written_once_and_narrow(spark, sf):
    with watched() as paths:
        g = tables.graph(spark, sf)
    held = [spark.read.parquet(p) for p in paths if "numbered" not in p]
    assert all("uuid" not in d.columns or d.where("node_type = 'lineitem'").count() < N / 10 for d in held)
    assert all("eid" not in d.columns or d.where("label = 'Uses'").count() == 0 for d in held)
    lines = g.v.where("node_type = 'lineitem'")
    clones = lines.where(F.col("vid") % tables.BASE >= tables.CLONE).count()
    assert (clones, lines.count()) == (4, N + 4)  # orders 2 and 133 with two lines each
    used = sum(2 + (i % 90 in (0, 89) and i % 200 % 2 == 0) for i in range(N))
    assert g.e.where("label = 'Uses'").count() == used and g.e.where("label = 'BelongsTo' AND eid IS NULL").count() == 0
    assert g.v.select("vid").distinct().count() == g.v.count()


def test_folders_are_written_without_a_sort(spark, rows):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("k"))
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    assert rows(cut(df, "parts", ("k",))) == rows(df) and spark.conf.get(key) == before


def test_lines_may_be_compressed(tiny, spark, tmp_path):
    g = tiny.v(1, "region", uri="/r/1", id="r").v(2, "tenant", uri="/t", id="t").e(1, 2, contains="OUT").graph()
    flat = lambda df: sorted(str(r.asDict()) for r in df.collect())
    for whole in (True, False):
        path = tmp_path / f"s{whole}"
        snap.write_snapshot(g.v, g.e, str(path), 2, "inv-", whole=whole, compression="gzip")
        assert all(gzip.decompress(f.read_bytes()) for f in path.glob("part-*.txt.gz")) and not [*path.glob("part-*.txt")]
        v, e = snap.read_snapshot(spark, str(path), "inv-")
        assert flat(v) == flat(g.v) and flat(e) == flat(g.e)
    docs = new_path(spark, "docs")
    payload.write_documents(payload.build_payload(g.v, g.e, g.v.where("vid = 1")), g.v, docs, 1, "gzip")
    assert [r["value"] for r in spark.read.text(docs).where("trim(value) <> ''").select(F.get_json_object("value", "$.uri").alias("value")).collect()] == ["/r/1"]


def test_buckets_grow_in_number_and_not_in_size(tiny, spark, monkeypatch):
    for i in range(60):
        tiny.v(i, "x").e(i, (i * 7) % 60)
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 2)
    g = tiny.graph()
    b = bucketed.write_graph(Graph(g.v, g.e, g.nt, g.rules))
    n = spark.read.parquet(f"{b.path}/layout").first()["buckets"]
    assert n >= 30 and b.out.all().count() == b.into.all().count() == 60


def test_grooming_keeps_verdicts_and_suspects_only(tiny, spark, rows):
    """The checks hold no long texts, and only edges with a suspect end meet the verdicts on their ends."""
    tiny.type("a", ["id"]).type("b", ["id"], ["a"])
    for i in range(40):
        tiny.v(i, "b" if i % 2 else "a", id=i).e(i, i - 1 if i % 2 else i, contains="IN" if i % 2 else "NONE")
    tiny.v(50, "a").v(51, "", id=51).v(52, "b", id=52, uuid="52dummy").e(0, 50, eid="keyless").e(2, 51, eid="untyped").e(4, 99, eid="absent")
    tiny.es.append(("open", 6, None, "L", "NONE", "NONE", "NONE", None, {}))
    g = tiny.graph()
    with watched() as paths:
        found = groom.groom(g.v, g.e, g.nt)
    held = {p.rsplit("/", 1)[1].split("-")[0]: spark.read.parquet(p) for p in paths}
    assert "uri" not in held["checks"].columns and rows(held["checks"].where("uuid IS NOT NULL").select("vid")) == [(52,)]
    assert rows(held["suspect_edges"].select("eid")) == [("absent",), ("keyless",), ("open",), ("untyped",)]
    assert sorted((r.eid, r.side, r.bad_vid, r.reason) for r in found.bad_edges.collect()) == [
        ("absent", "dst", 99, "absent"), ("keyless", "dst", 50, "missing_keys"), ("open", "dst", None, "absent"), ("untyped", "dst", 51, "untyped")]
    assert groom.groom_summary(found).first()["orphans"] == 0


def test_report_of_deleted_edges_reads_edges_in_place(tiny, spark, rows):
    for i in range(20):
        tiny.e(i, i + 1, eid=f"e{i % 10}")
    g = tiny.graph()
    ids = spark.createDataFrame([("e3",), ("e3",), ("none",)], "eid string")
    e = cut(g.e, "edges")
    report = repair.delete_edges(e, ids)[1]
    assert rows(report) == [("e3", 3, 4, "L", "deleted"), ("e3", 13, 14, "L", "deleted"), ("none", None, None, None, "not_found")]
    plan = report._jdf.queryExecution().sparkPlan().toString()
    assert "LeftSemi, BuildRight" in plan


def test_files_of_a_snapshot_hold_ranges_of_ids(tiny, spark, tmp_path):
    """Neighbouring vertices go to one file: their lines, and the rows dealt for them, are alike."""
    for i in range(1, 201):
        tiny.v(i, "x").e(i, i % 200 + 1)
    g = tiny.graph()
    snap.write_snapshot(g.v, g.e, str(tmp_path / "s"), 4, "inv-")
    lines = snap.read_lines(spark, str(tmp_path / "s")).select("id", F.input_file_name().alias("file"))
    spans = sorted((r.low, r.high) for r in lines.groupBy("file").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and lines.count() == 200


def test_edges_are_told_apart_without_an_exchange(tiny, spark, rows):
    tiny.type("a", ["id"]).type("b", ["id"]).rule("a", "b", "L")
    tiny.v(1, "a").v(2, "b").v(3, "a").e(1, 2).e(1, 2).e(1, 2, label="M").e(3, 2).e(3, 9).e(1, 3)
    g = tiny.graph()
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        counts = audit.edge_counts(g.e, g.v, g.rules, g.nt)
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(src" in x and "dst" in x]
    assert rows(counts) == [("edge__UNKNOWN", 1), ("edge__a__b", 3)]
    twice = g.v.unionByName(g.v.where("vid = 1"))  # a vertex listed twice counts twice
    assert rows(audit.edge_counts(g.e, twice, g.rules, g.nt)) == [("edge__UNKNOWN", 2), ("edge__a__b", 5)]


def test_a_round_deals_only_rows_that_were_not_accepted(tiny, spark, rows):
    for i, (uri, uuid) in enumerate([("/a", "u1"), ("/a", "u2"), ("/b", "u2"), ("/c", "u1"), ("/d", "u4"), ("/d", "u5"), ("/e", "u5")]):
        tiny.v(i, "a", uri=uri, uuid=uuid)
    g = tiny.type("a", ["id"]).graph()
    with watched() as paths:
        taken = audit.accept_vertices(g.v, g.nt)
    assert rows(taken.select("vid")) == [(0,), (2,), (4,), (6,)]
    ranked = [spark.read.parquet(p) for p in paths if "/ranked-" in p]
    assert rows(ranked[0].where("_both").select("vid")) == [(0,), (4,)] and not [p for p in paths if "/accepted-" in p]


def test_a_snapshot_is_written_in_parts_that_leave_no_shuffle_files(tiny, spark, tmp_path, monkeypatch, rows):
    """Each part of the ids is dealt by itself; together they are the snapshot."""
    for i in range(1, 121):
        tiny.v(i, "x").e(i, i % 120 + 1).e(i, 500 + i)
    tiny.es.append(("open", None, 3, "L", "NONE", "NONE", "NONE", None, {}))
    g = tiny.graph()
    monkeypatch.setattr(snap, "RUN_BITS", 2)
    monkeypatch.setattr(snap, "PART_FILES", 1)
    dealt, part = [], snap._part
    monkeypatch.setattr(snap, "_part", lambda *a: dealt.append(part(*a)) or dealt[-1])
    path = str(tmp_path / "s")
    snap.write_snapshot(g.v, g.e, path, 6, "inv-")
    assert len(dealt) == snap.PARTS and all(0 < v.count() < 60 for v, _ in dealt)
    ends = [r["vid"] for _, x in dealt for r in x.collect()]
    assert len(ends) == 2 * g.e.count() and sum(x is None for x in ends) == 1
    lines = snap.read_lines(spark, path)
    assert rows(lines.select("id")) == [(i,) for i in range(1, 121)] and len(list((tmp_path / "s").glob("part-*"))) > snap.PARTS
    assert (tmp_path / "s" / "_SUCCESS").exists()
    e = snap.read_snapshot(spark, path, "inv-")[1]
    assert rows(e.select("eid")) == rows(g.e.where("src IS NOT NULL").select("eid"))
    assert "open" in str(lines.where("id = 3").select("inE").collect())


def test_reload_shuffles_ids_and_no_edges(tiny, spark, rows):
    """Edges meet the few ends that are absent or repeated; repeated vertices give an edge for each pair."""
    tiny.v(1, "a").v(2, "a").v(3, "a").v(3, "a").e(1, 2, eid="ok").e(1, 3, eid="twice").e(3, 3, eid="four").e(1, 9, eid="dst").e(8, 3, eid="src").e(8, 9, eid="both")
    tiny.es.append(("open", None, 2, "L", "NONE", "NONE", "NONE", None, {}))
    g = tiny.graph()
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        _, e, _, errors = snap.reload_with_new_ids(g.v, cut(g.e, "edges"), 100)
        assert "Exchange hashpartitioning" not in e._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert rows(e.select("eid", "src", "dst")) == [("four", 103, 103)] * 4 + [("ok", 101, 102)] + [("twice", 101, 103)] * 2
    found = {(r.eid, r.src, r.dst, r.unmapped) for r in errors.collect()}
    assert found == {("dst", 1, 9, "dst"), ("src", 8, 3, "src"), ("both", 8, 9, "src"), ("open", None, 2, "src")} and errors.count() == 5


def test_documents_are_dealt_once_and_in_parts(tiny, spark, tmp_path, monkeypatch):
    for i in range(1, 41):
        tiny.v(i, "region", uri=f"/r{i}", id=i).v(100 + i, "tenant", uri=f"/t{i}", id=i).e(i, 100 + i, contains="OUT")
    g = tiny.v(7, "region", uri="/r7", id=7).graph()
    pieces = payload.build_payload(g.v, g.e, g.v.where("node_type = 'region' AND vid <> 7"))
    dealt = payload.document_pieces(pieces, g.v.where("vid <> 9"), 8)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Join" not in plan.split("REPARTITION_BY_NUM")[0]
    monkeypatch.setattr(payload, "PART_FILES", 2)
    parts, one = [], payload.document_pieces
    monkeypatch.setattr(payload, "document_pieces", lambda *a: parts.append(one(*a)) or parts[-1])
    path = str(tmp_path / "docs")
    payload.write_documents(pieces, g.v.where("vid <> 9"), path, 8)
    lines = [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]
    want = [f'{{"uri":"/r{i}","payload":{{"id":"{i}"' for i in range(1, 41) if i not in (7, 9)]
    assert len(parts) == payload.PARTS and sorted(x.split(" ")[0] for x in lines) == sorted(want)


def test_claims_are_numbers_and_texts_are_dealt_once(tiny, spark, rows):
    """Only the first table comes from texts; uuids that look like each other's bytes stay apart."""
    for i, (uri, uuid) in enumerate([("/a", "6162"), ("/b", "ab"), ("/c", "6162"), ("/d", "hab"), ("/d", "zz"), ("/e", "zz"), ("/f", "AB")]):
        tiny.v(i, "a", uri=uri, uuid=uuid)
    g = tiny.type("a", ["id"]).graph()
    with watched() as paths:
        taken = audit.accept_vertices(g.v, g.nt)
    assert rows(taken.select("vid")) == [(0,), (1,), (3,), (5,), (6,)]
    for p in paths:
        held = spark.read.parquet(p)
        assert all(f.dataType.typeName() in ("long", "boolean") for f in held.schema), held.schema


def test_lines_of_a_snapshot_are_parsed_once_and_for_what_is_read(tiny, spark, tmp_path, rows):
    """A reader of vertices builds no edges, one of edges no properties, and no filter parses a line again."""
    g = tiny.v(1, "a", id="x").v(2, "a", id="y").e(1, 2).graph()
    path = snap.write_snapshot(g.v, g.e, str(tmp_path / "s"), 1, "inv-")
    v, e = snap.read_snapshot(spark, path, "inv-")
    for df, absent in ((v, "outE"), (e, "inE"), (e, "StructField(properties,MapType(StringType,ArrayType")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        parses = plan.split("from_json(")[1:]
        # the other one is that of a line found faulty
        assert len([x for x in parses if "value#" in x.split(" Some(")[0]]) == 1 and len(parses) == 2 and absent not in plan
    assert rows(v.select("vid", "props")) == rows(g.v.select("vid", "props")) and rows(e.select("eid")) == rows(g.e.select("eid"))


def test_a_line_with_a_fault_is_judged_by_its_id(spark, tmp_path, rows):
    """What was read of a line before its fault doesn't make it a vertex; a value of another kind is no fault of the line."""
    line = '{"id":%d,"label":"vertex","properties":{"inv-uri":[{"id":"u","value":"/%d"}]},"outE":{"L":[{"id":"e%d","inV":%s,"properties":{}}]}}'
    whole, odd = line % (1, 1, 1, 2), line % (2, 2, 2, '"no number"')
    broken = [(line % (9, 9, 9, 1))[:-n] for n in range(1, 75)]
    (tmp_path / "s").write_text("\n".join([whole, odd, *broken]) + "\n")
    v, e = snap.read_snapshot(spark, str(tmp_path / "s"), "inv-")
    assert rows(v.select("vid", "uri")) == [(1, "/1"), (2, "/2")]
    assert rows(e.select("eid", "src", "dst").where("src = 1")) == [("e1", 1, 2)] and e.where("src = 9").count() == 0
    assert snap.unreadable_lines(spark, str(tmp_path / "s")).count() == len(broken)


def test_texts_that_need_an_escape_are_written_with_it(tiny, spark, tmp_path):
    odd = ['q"q', "back\\slash", "tab\tand\x01", "}", "", "\u00e9\u4e2d", "{\"a\":[1]}"]
    for i, text in enumerate(odd):
        tiny.v(i, "a", uri=f"/{text}", uuid=f"u{text}", p=text).v(100 + i, text, q="plain")
    tiny.vs.append((300, "a", None, None, None, None, None, None, None, {}))
    tiny.vs.append((301, "a", "/301", None, "1", 5, 6, 7, "S", {"k": None, 'k"2': "v"}))
    g = tiny.graph()
    path = snap.write_snapshot(g.v, g.e, str(tmp_path / "s"), 2, 'in"v-')
    v, _ = snap.read_snapshot(spark, path, 'in"v-')
    flat = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    assert flat(v) == flat(g.v)


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def at_most(spark, limit: int) -> bool:
    """Whether no more shuffle files stay; they go a little behind the end of an execution."""
    until = time.monotonic() + 30
    while shuffle_files(spark) > limit and time.monotonic() < until:
        time.sleep(0.1)
    return shuffle_files(spark) <= limit


def ring(tiny, n: int = 40):
    for i in range(n):
        tiny.v(i, "x").e(i, (i * 7) % n)
    return tiny.graph()


def test_a_bucketed_graph_leaves_no_shuffle_files_and_is_zstd(tiny, spark, tmp_path, rows):
    g = ring(tiny)
    v, e = cut(g.v, "v"), cut(g.e, "e")
    before = shuffle_files(spark)
    b = bucketed.write_graph(Graph(v, e, g.nt, g.rules), str(tmp_path / "b"), 4)
    assert at_most(spark, before + 4)  # of the two counts, a row per task
    for name in ("vertices", "by_src", "by_dst"):
        files = [f.name for f in (tmp_path / "b" / name).glob("part-*")]
        assert files and all(".zstd.parquet" in f for f in files)
    assert rows(b.out.all().select("eid")) == rows(b.into.all().select("eid")) == rows(g.e.select("eid"))


def test_edges_made_anew_are_written_zstd(tiny, spark):
    g = ring(tiny.rule("x", "x", "L", multiplicity="MANY2ONE"))
    with watched() as paths:
        migrate.rebuild_edges(g.e, g.v, g.rules)
    held = [f for p in paths if "rebuilt" in p for f in spark.read.parquet(p).inputFiles()]
    assert held and all(".zstd.parquet" in f for f in held)


def test_a_load_keeps_what_the_store_names_and_no_more(tiny, spark, tmp_path, rows):
    """Stages of the ids and the errors beside the store go, also where a load fails; tables of the store are zstd."""
    g = ring(tiny)
    v, e = cut(g.v, "v"), cut(g.e, "e")
    store = VersionedStore(spark, str(tmp_path / "store"))
    with watched() as paths:
        with pytest.raises(snap.LoadFailed):
            id_map.load(store, v.where("vid < 20"), e, 100, max_errors=0)
        now = id_map.load(store, v, e, 100, max_errors=None)
    assert paths and not [p for p in paths if (tmp_path.__class__(p.removeprefix("file:").replace("///", "/"))).exists()]
    assert all(".zstd.parquet" in f for t in ("vertices", "edges") for f in store.read(t, now).inputFiles())
    assert rows(id_map.id_map(store)) == [(i, 100 + i) for i in range(40)]
    assert rows(store.read("edges", now).select("src", "dst")) == sorted((100 + i, 100 + (i * 7) % 40) for i in range(40))
    before = shuffle_files(spark)
    store.commit(now, {"edges": e.repartition(4, "src")})
    assert at_most(spark, before)
