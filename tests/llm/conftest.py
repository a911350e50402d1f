from __future__ import annotations

import duckdb
import pytest

from tools.check_oracle import TABLES, rows_of


@pytest.fixture(scope="session")
def same(spark, sf):
    """Compares a registered query with its SQL on the smallest tables."""
    from tidewatch.llm import queries

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    def check(name):
        got, want = queries.QUERIES[name](spark, sf).toArrow(), con.sql(queries.ORACLE[name]).to_arrow_table()
        assert rows_of(got) == rows_of(want)

    return check
