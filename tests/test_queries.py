"""Every query with an oracle against DuckDB on the smallest tables; the others for rows and a stable schema."""

import math
import uuid
from pathlib import Path

import duckdb
import pytest

from gridmend.plans import QUERIES, stored

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x


def rows(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_its_oracle(spark, small, oracle, name):
    ours = QUERIES[name](spark, small).toPandas()
    theirs = oracle.execute(QUERIES[name].sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a, b = rows(ours, columns), rows(theirs, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-5)), (x, y)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_without_oracle_repeats(spark, small, name):
    first = QUERIES[name](spark, small)
    assert first.count() > 0
    again = QUERIES[name](spark, small)
    assert first.schema == again.schema
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))


@pytest.mark.parametrize("name", ["pinned_files", "provenance", "run_audit"])
def test_role_files_in_a_shared_folder_without_a_scheme(spark, small, oracle, name, monkeypatch, tmp_path):
    monkeypatch.setattr(stored, "scratch_path", lambda session, kind: f"{tmp_path}/{kind}-{uuid.uuid4().hex}")
    test_query_equals_its_oracle(spark, small, oracle, name)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert Path(e.__file__).exists()
