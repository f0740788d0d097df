"""The queries with SQL against DuckDB, and the contract of all of them, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from stationflow.llm.queries import QUERIES, SQL, _canonical_sql
from stationflow.llm.licence_scan import canonical_text

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    expected = con.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r)) for r in found.select(*columns).collect())


def test_canonical_text_equals_sql(spark):
    texts = [
        "Copyright (c) 2020 X\nThe LICENCE, favour!", "  the copyright notice\n(c) 2\n(c)\n© me\nend", "a\n\n* Copyright holder says\n# copyright, all",
        "Où — «licence» ne1 ²", "", "...", "copyrighted work",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(canonical_text(df.t)).collect()]
    con = duckdb.connect()
    assert found == [con.execute(f"SELECT {_canonical_sql('x')} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchone()[0] for t in texts]


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op5_quality_classifier", "op7_language_model"}))
def test_query_runs(spark, name):
    found = QUERIES[name](spark, FOLDER)
    assert found.columns[0] in ("doc_id", "page_id", "conv_id") and found.count() > 0
