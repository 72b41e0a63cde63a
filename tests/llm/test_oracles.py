"""The text queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from gridmend.llm import entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_oracle(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    ours, theirs = entry.queries()[name](spark, small).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    key = lambda df: sorted(tuple(r) for r in df[columns].itertuples(index=False))
    assert key(ours) == key(theirs)


def test_all_are_registered():
    found = entry.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in found)] == []
