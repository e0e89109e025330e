"""The catalogue on the smallest tables, against DuckDB."""

import math
import os

import duckdb
import pytest

from textmill.plans import catalogue

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


QUICK = [n for n in catalogue.ORACLE if not n.startswith(("dedupe", "pipeline", "low", "recommend", "stream"))]


@pytest.mark.parametrize("name", [*QUICK, "dedupe_removed_06", "dedupe_groups", "dedupe_stats", "pipeline_stats_pages", "recommendations", "stream_batch_stats"])
def test_same_as_duckdb(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = oracle.sql(catalogue.ORACLE[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
