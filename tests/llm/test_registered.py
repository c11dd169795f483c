"""What is registered, and the SQL of those queries that have some."""

import os
import re

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_each_operator_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and "pipeline" not in {n for n, q in entry.oracle_sql().items() if q}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", [
    "op6_ngram_jaccard_join", "op9_secret_scans", "op11_importance_resampling", "op12_prefix_trie", "op13_minhash_near_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    normal = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))
    assert normal(map(tuple, got.select(*columns).collect())) == normal(want.fetchall())
