"""Queries cover their whole tables."""

from gridmend.plans import QUERIES


def test_outage_trace_has_all_units(spark, small):
    units = {r.p_partkey for r in spark.read.parquet(f"{small}/part.parquet").select("p_partkey").collect()}
    got = QUERIES["outage_trace"](spark, small).collect()
    assert len(units) > 60 and {r.unit for r in got} == units
    assert all(0 < r.quarters_up <= 2880 for r in got)
