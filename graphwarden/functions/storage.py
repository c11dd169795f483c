"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_session_dirs: dict[str, str] = {}
#: lists of the tables that this thread writes, for those who asked for them
_watchers = threading.local()
#: shuffle files of an execution go as soon as it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: a task with up to so many files open needs no sort by their folder, which would spill
_WRITERS, _OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", "16"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on (all are per-session SQL settings)."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even where the result is shuffled once more for it
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # rows grow many times over behind a scan (texts, both ends of edges), so a task begins with few of them
        "spark.sql.files.maxPartitionBytes": "16m",
    }.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local master may fall back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="graphwarden-")
    return _local_dirs[app]


def session_dir(spark: SparkSession) -> str:
    """Folder of this session inside the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _session_dirs:
        _session_dirs[app] = f"{work_dir(spark)}/graphwarden-{app}-{uuid.uuid4().hex}"
    return _session_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def watched() -> Iterator[list[str]]:
    """Paths of the tables that ``cut`` writes meanwhile in this thread; other threads' tables are not among them."""
    paths: list[str] = []
    lists = _watchers.__dict__.setdefault("lists", [])
    lists.append(paths)
    try:
        yield paths
    finally:
        lists[:] = [x for x in lists if x is not paths]  # lists of two watchers may be equal


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete written tables (frames of ``cut``, or paths) that nothing will read again."""
    for t in tables:
        if isinstance(t, str):
            _delete(spark, t)
        else:
            _delete(t.sparkSession, t._path)


def release(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder.

    Frames returned by the operators read those tables: write your results first.
    """
    path = _session_dirs.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def swept(spark: SparkSession):
    """Inside, the shuffle files of each execution go as soon as it ends."""
    return _set(spark, {_CLEANUP: "true"})


def cut(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = (), compression: str | None = None, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table replaces the lineage, so a lost executor costs a re-read
    and not a re-run of all earlier levels of a loop.  The shuffle files behind
    it are no longer needed then and go at once.  ``compression`` is ``zstd`` where the table is wide text and large;
    ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _set(spark, {_CLEANUP: "true", **({_WRITERS: _OPEN_FILES} if partition_by else {})}):
        writer.options(**options).parquet(path, compression=compression)
    for paths in getattr(_watchers, "lists", ()):
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._written, out._path = True, path
    return out


def written(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """``df`` as a written table, for frames that a plan reads several times."""
    return df if getattr(df, "_written", False) else cut(df, name, compression=compression)
