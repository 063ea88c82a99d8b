"""Queries with SQL against DuckDB; all queries over empty tables."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tidelog.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([r[i] for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(ORACLE[name])
    want = ordered([d[0] for d in result.description], result.fetchall())
    df = QUERIES[name](spark, SF)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    query = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert query(spark, empty_dir).count() == 0
