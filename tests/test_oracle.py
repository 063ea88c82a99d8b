"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_module
import workload

SF = Path("/root/testdata/sf0.001")
ORACLE = workload.ORACLE

pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(norm(v) for v in value) if isinstance(value, list) else value


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith("stream_")))
def test_query_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, str(SF))
    result = con.execute(ORACLE[name])
    want = ordered([d[0] for d in result.description], result.fetchall())
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_query_has_sql():
    assert set(ORACLE) == set(workload.QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
