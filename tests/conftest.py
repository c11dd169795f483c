import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphwarden.functions.storage import configure, release  # noqa: E402
from graphwarden.model import EDGE_DDL, EDGE_RULE_DDL, Graph, NODE_TYPE_DDL, VERTEX_DDL  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")  # the one machine's part of what a cluster shares
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", shared.as_uri()).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    release(session)
    session.stop()


class Tiny:
    """Hand-made graphs as lists."""

    def __init__(self, spark):
        self.spark, self.vs, self.es = spark, [], []
        self.nt, self.rules = [], []

    def type(self, name, keys, parents=(), top=False, lists=(), template=""):
        self.nt.append((name, list(keys), list(parents), top, list(keys), [], [], list(lists), {}, template))
        return self

    def rule(self, a, b, label, contains="NONE", multiplicity="MANY2MANY", delete="NONE", prevent="NONE", private=False):
        self.rules.append((a, b, label, "OUT", multiplicity, contains, delete, prevent, True, private))
        return self

    def v(self, vid, node_type, uri=None, version="1", end_ts=None, mod=None, source="X", uuid=None, **props):
        props = {k.replace("_", "-"): str(x) for k, x in props.items()}
        self.vs.append((vid, node_type, f"/{vid}" if uri is None else uri, uuid or f"u{vid}", version, mod, mod, end_ts, source, props))
        return self

    def e(self, src, dst, label="L", contains="NONE", end_ts=None, eid=None, **props):
        self.es.append((eid or f"{label}:{src}:{dst}:{len(self.es)}", src, dst, label, contains, "NONE", "NONE", end_ts, props))
        return self

    def graph(self):
        make = self.spark.createDataFrame
        return Graph(make(self.vs, VERTEX_DDL), make(self.es, EDGE_DDL), make(self.nt, NODE_TYPE_DDL),
                     make(self.rules, EDGE_RULE_DDL))


@pytest.fixture
def tiny(spark):
    return Tiny(spark)


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""
    return lambda df: sorted(tuple(r) for r in df.collect())
