"""A graph laid out for joins without an exchange: bucketed by vertex id, edges once by each end."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphwarden.functions.storage import new_path, swept
from graphwarden.model import EDGE_COLS, EDGE_DDL, Graph, VERTEX_COLS, VERTEX_DDL


#: rows of a bucket, where the caller doesn't name the number of buckets
BUCKET_ROWS = 500_000


@dataclass(frozen=True)
class EndEdges:
    """Edges laid out by one end.

    ``rest`` is bucketed and sorted by that end.  ``hubs`` holds the edges of ends with more edges than a bucket should
    have: fewer than there are buckets, whatever the graph, so that their facts are broadcast and no bucket grows hot.
    """

    side: str
    rest: DataFrame
    hubs: DataFrame
    hub_ids: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.rest.columns

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> EndEdges:
        """``fn`` on both parts; an end is in one of them alone, so what is grouped by it may be grouped by part."""
        return EndEdges(self.side, fn(self.rest), fn(self.hubs), self.hub_ids)

    def all(self) -> DataFrame:
        return self.rest.unionByName(self.hubs)

    def join(self, facts: DataFrame, how: str = "inner") -> DataFrame:
        """Edges with the facts, one row per id in a column named like the end."""
        of_hubs = facts.join(F.broadcast(self.hub_ids), self.side, "left_semi")
        return self.rest.join(facts, self.side, how).unionByName(self.hubs.join(F.broadcast(of_hubs), self.side, how))

    def per_end(self, *aggregates, where=None) -> tuple[DataFrame, DataFrame]:
        """Aggregates per id as ``vid``: those of the buckets, and those of the hubs (fewer rows than buckets)."""
        parts = self if where is None else self.map(lambda d: d.where(where))
        by = lambda d: d.groupBy(F.col(self.side).alias("vid")).agg(*aggregates)
        return by(parts.rest), by(parts.hubs)


@dataclass(frozen=True)
class BucketedGraph:
    v: DataFrame
    out: EndEdges
    into: EndEdges
    nt: DataFrame
    rules: DataFrame
    path: str


def _open(spark: SparkSession, path: str, ddl: str, key: str, n: int) -> DataFrame:
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def open_graph(spark: SparkSession, path: str, nt: DataFrame, rules: DataFrame) -> BucketedGraph:
    """A graph that ``write_graph`` has written, in this session or an earlier one."""
    n = spark.read.parquet(f"{path}/layout").first()["buckets"]

    def edges(side: str) -> EndEdges:
        hubs = spark.read.schema(EDGE_DDL).parquet(f"{path}/hubs_{side}")
        ids = spark.read.schema(f"{side} BIGINT").parquet(f"{path}/hub_ids_{side}")
        return EndEdges(side, _open(spark, f"{path}/by_{side}", EDGE_DDL, side, n), hubs, ids)

    return BucketedGraph(_open(spark, f"{path}/vertices", VERTEX_DDL, "vid", n), edges("src"), edges("dst"), nt, rules, path)


def write_graph(g: Graph, path: str | None = None, buckets: int | None = None) -> BucketedGraph:
    """Write ``g`` bucketed by vertex id (edges twice, by ``src`` and by ``dst``) and open it.

    ``buckets`` is the session's number of shuffle partitions where it is not given, or more where a bucket would hold above
    ``BUCKET_ROWS`` edges or vertices, which a task sorts; with fewer, joins would shuffle again.  A vertex with
    more than an average bucket of edges at an end is a hub of that end; edges with a null end are in no bucket's join and
    stay in ``rest``.
    """
    spark = g.v.sparkSession
    path = path or new_path(spark, "bucketed")
    v, e = g.v.select(*VERTEX_COLS), g.e.select(*EDGE_COLS)
    n_edges = e.count()
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(n_edges, v.count()) // BUCKET_ROWS))

    def write(df: DataFrame, name: str, key: str) -> None:
        table = f"writing_{uuid.uuid4().hex}"
        # a task per bucket writes one file; texts repeat, and zstd takes half the room of the default for them
        with swept(spark):
            df.repartition(n, key).write.options(path=f"{path}/{name}", compression="zstd").bucketBy(n, key).sortBy(key).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # an external table: the files stay

    write(v, "vertices", "vid")
    share = max(n_edges // n, 1)
    for side in ("src", "dst"):
        hubs = e.where(F.col(side).isNotNull()).groupBy(side).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
        with swept(spark):
            hubs.select(side).coalesce(1).write.parquet(f"{path}/hub_ids_{side}")  # fewer rows than buckets
        ids = F.broadcast(spark.read.parquet(f"{path}/hub_ids_{side}"))
        e.join(ids, side, "left_semi").select(*EDGE_COLS).write.parquet(f"{path}/hubs_{side}", compression="zstd")
        write(e.join(ids, side, "left_anti").select(*EDGE_COLS), f"by_{side}", side)
    spark.createDataFrame([(n,)], "buckets int").write.parquet(f"{path}/layout")
    return open_graph(spark, path, g.nt, g.rules)


def with_ends(e: DataFrame | EndEdges, src: DataFrame, dst: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with facts of both ends (frames with one row per ``src`` and per ``dst``).

    Bucketed edges meet the facts of the end they are laid out by in place; only what came of that, not a table, is
    shuffled to the other end.
    """
    if not isinstance(e, EndEdges):
        return e.join(src, "src", how).join(dst, "dst", how)
    first, second, key = (src, dst, "dst") if e.side == "src" else (dst, src, "src")
    return e.join(first, how).join(second, key, how)
