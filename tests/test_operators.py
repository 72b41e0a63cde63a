import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridmend.functions import scalar as s
from gridmend.functions import text
from gridmend.operators import checks, economics, graph, hazard, relational, renewal, scan, stats, supply, support


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_damage_function(spark):
    df = spark.createDataFrame([(float(d),) for d in (0, 12, 24, 48, 96)], "d double")
    got = [r[0] for r in df.select(s.interrupted_kw_cost(F.col("d"), 2.0, (24.0, 48.0, 96.0), (1.0, 2.0, 4.0))).collect()]
    assert got == pytest.approx([0, 24, 48, 96, 192])


def test_capital_recovery(spark):
    got = one(spark, a=s.capital_recovery_factor(F.lit(0.031), 20), b=s.capital_recovery_factor(F.lit(0.0), 20))
    assert got["a"] == pytest.approx(0.031 * 1.031**20 / (1.031**20 - 1)) and got["b"] == 0.05


def test_normal_cdf(spark):
    xs = [-3.0, -1.0, 0.0, 0.5, 2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(s.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-7)


def test_booleans(spark):
    df = spark.createDataFrame([("TRUE",), ("0",), ("y",), (None,)], "x string")
    assert [r[0] for r in df.select(s.lenient_boolean(F.col("x"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(s.extended_boolean(F.col("x"))).collect()] == [True, False, True, False]
    assert [r[0] for r in df.select(s.boolean_token(F.col("x"))).collect()] == [True, None, True, None]
    with pytest.raises(Exception, match="not a boolean"):
        df.select(s.strict_boolean(F.col("x"))).collect()


def test_tokens(spark):
    line = F.lit("New Load.A1 bus1=x.1.2 kv=0.24 conns=(wye, delta) bus1=y ! kw=3")
    got = one(spark, t=text.tokens(text.without_comment(line)), e=text.element(line))
    assert [tuple(x) for x in got["t"]] == [("bus1", "x.1.2"), ("kv", "0.24"), ("conns", "wye, delta"), ("bus1", "y")]
    assert tuple(got["e"]) == ("load", "a1")


def test_waterfall(spark):
    df = spark.createDataFrame([("A", 20.0, False, 1.0), ("B", 6.0, False, 2.0), ("D", 3.0, False, 0.5)], "id string, mw double, critical boolean, voll double").withColumn("g", F.lit(1))
    got = scan.waterfall(df, ["g"], "mw", F.lit(15.0), [F.desc("critical"), F.desc("voll"), F.desc("mw"), F.col("id")])
    assert {r.id: r.given for r in got.collect()} == {"B": 6.0, "A": 9.0, "D": 0.0}


def test_skipping_prefix(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((6, 9, 3, 2, 1))], "g int, i int, size double")
    assert sorted(r.i for r in scan.take_under_cap(df, ["g"], "size", 10.0, ["i"]).collect()) == [0, 2, 4]


def test_as_of_clamps_to_the_first_step(spark):
    steps = spark.createDataFrame([(1, 2.0, "a"), (1, 5.0, "b")], "g int, at double, v string")
    points = spark.createDataFrame([(1, 0), (1, 2), (1, 4), (1, 9)], "g int, t int")
    got = relational.as_of(points, steps, ["g"], "t", "at", ["v"])
    assert sorted((r.t, r.v) for r in got.collect()) == [(0, "a"), (2, "a"), (4, "a"), (9, "b")]


def test_union_time_counts_overlaps_once(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0), (1, 2.0, 6.0), (1, 8.0, 9.0)], "g int, start double, end double")
    r = relational.union_time(df, ["g"]).first()
    assert (r.union_time, r.total_time) == (7.0, 9.0)


def test_conflicts_tell_null_from_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None)], "k int, x string")
    assert [r.k for r in relational.conflicting(df, ["k"]).collect()] == [2]


def test_components_and_reachability(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(k, k + 1) for k in range(200, 260)]
    nodes = sorted({x for p in pairs for x in p} | {999})
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), edges)
    assert {r.node: r.component for r in got.collect()} == {n: top(n) for n in nodes}
    near = graph.reachable(edges, spark.createDataFrame([(200,)], "node long"))
    assert {r.node for r in near.collect()} == {n for n in nodes if top(n) == top(200)}


def test_parallel_edges_block_the_pair(spark):
    edges = spark.createDataFrame([("e0", "s", "a"), ("e1", "a", "s"), ("e2", "a", "b")], "edge_id string, a string, b string")
    hit = spark.createDataFrame([(1, "e1")], "scenario int, edge_id string")
    source = spark.createDataFrame([("s",)], "node string")
    reached = lambda bundled: sorted(r.node for r in graph.reachable_in_cases(edges, hit, source, bundled=bundled).collect())
    assert reached(True) == ["s"] and reached(False) == ["a", "b", "s"]


@pytest.mark.parametrize("bundled", [True, False])
def test_reachability_in_many_cases(spark, bundled):
    rng = np.random.default_rng(6)
    ends = [(int(a), int(b)) for a, b in rng.integers(0, 25, (40, 2))] + [(0, 1), (0, 1), (1, 2), (3, 3)]
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ends)], "edge_id int, a int, b int")
    damage = {(int(c), int(e)) for c, e in zip(rng.integers(0, 150, 1500), rng.integers(0, len(ends), 1500), strict=True)}
    lost = {(int(c), int(n)) for c, n in zip(rng.integers(0, 160, 200), rng.integers(0, 25, 200), strict=True)}
    case = lambda rows, name: spark.createDataFrame(sorted(rows), f"scenario int, {name} int")
    got = graph.reachable_in_cases(edges, case(damage, "edge_id"), spark.createDataFrame([(0,), (7,)], "node int"), bundled=bundled, lost=case(lost, "node"), cases=spark.range(170).select(F.col("id").cast("int").alias("scenario")))
    want = set()
    for c in range(170):
        pairs = {}
        for i, (a, b) in enumerate(ends):
            pairs.setdefault((min(a, b), max(a, b)), []).append((c, i) in damage)
        ways = [p for p, hit in pairs.items() if not (any(hit) if bundled else all(hit))]
        front = seen = {n for n in (0, 7) if (c, n) not in lost}
        while front:
            front = {y for a, b in ways for x, y in ((a, b), (b, a)) if x in front and y not in seen and (c, y) not in lost}
            seen = seen | front
        want |= {(c, n) for n in seen}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 500


def test_capacity_table(spark):
    units = [(2, 0.1), (3, 0.2), (5, 0.3)]
    df = spark.createDataFrame([(1, m, q) for m, q in units], "f int, capacity_mw long, q double")
    table = supply.capacity_table(df, ["f"])
    demands = spark.createDataFrame([(1, float(d)) for d in (0.0, 2.5, 7.0, 15.0)], "f int, demand double")
    got = {r.demand: (r.expected_shortage, r.p_shortage) for r in supply.shortage(table, demands, ["f"]).collect()}
    for d in (0.0, 2.5, 7.0, 15.0):
        want, prob = 0.0, 0.0
        for k in range(8):
            up = [k >> i & 1 for i in range(3)]
            p = math.prod((1 - q) if u else q for u, (_, q) in zip(up, units, strict=True))
            c = sum(m * u for u, (m, _) in zip(up, units, strict=True))
            want, prob = want + p * max(0.0, d - c), prob + p * (c < d)
        assert got[d] == pytest.approx((want, prob))


def test_allocation_rules(spark):
    for rule in ("conventional", "dc_first", "dc_priority_upper"):
        r = one(spark, **{k: c for k, c in zip("abc", supply.allocate(F.lit(50.0), F.lit(80.0), F.lit(20.0), F.lit(30.0), rule), strict=True)})
        assert r["a"] + r["c"] == pytest.approx(60.0) and r["b"] == 0.0
    with pytest.raises(ValueError):
        supply.allocate(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), "other")


def test_critical_damage(spark):
    got = one(spark, a=economics.load_damage(F.lit(2000.0), F.lit(10.0), F.lit("commercial"), F.lit(True)))
    assert got["a"] == 200_000.0


def test_substation_probabilities_add_up(spark):
    p = hazard.substation_states(F.lit(130.0))
    assert sum(one(spark, **p).values()) == pytest.approx(1.0, abs=1e-6)


def test_weighted_sample_is_whole_and_repeats(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), "id", (F.col("id") + 1.0).alias("w"))
    a = hazard.weighted_sample(df, ["g"], "w", "id", F.lit(5), 3).collect()
    assert len(a) == 10 and sorted(a) == sorted(hazard.weighted_sample(df.repartition(7), ["g"], "w", "id", F.lit(5), 3).collect())


def test_track_extension_reaches_the_least_speed(spark):
    df = spark.createDataFrame([(1, 0, 29.0, -95.0, 50.0), (1, 1, 29.2, -95.1, 45.0)], "storm int, time_index int, lat double, lon double, speed double")
    got = hazard.extended_track(df, ["storm"], 0.005).orderBy("time_index").collect()
    assert len(got) > 3 and got[-1].speed <= 20.0 < got[-2].speed


def test_bootstraps_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(10, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "id": range(400), "x": x}))
    low, high = stats.bootstrap_of(x, 800, 1)
    b = stats.poisson_bootstrap(df, ["g"], "x", F.col("id"), 400).first()
    assert low == pytest.approx(b.low, abs=0.08) and high == pytest.approx(b.high, abs=0.08)
    assert np.isnan(stats.bootstrap_of(np.array([np.nan]))).all()


def test_step_violations(spark):
    e = spark.createDataFrame([(1, 2, 3.0), (2, 1, 1.0)], "k int, n_steps int, ens double")
    st = spark.createDataFrame([(1, 0, 0.0, 1.0, 1.0), (1, 1, 1.5, 2.0, 2.0), (3, 0, 0.0, 1.0, 1.0)], "k int, step_index int, start double, end double, step_ens double")
    got = {(r.k, r.rule) for r in checks.step_violations(e, st, ["k"]).collect()}
    assert got == {(1, "steps are contiguous"), (2, "episode has steps"), (3, "steps have an episode")}


def test_sequence_violations(spark):
    orders = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "case int, place int, edge_id string")
    damaged = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "case int, edge_id string")
    assert {(r[0], r.rule) for r in checks.sequence_violations(orders, damaged, "case").collect()} == {(2, "only in order"), (2, "only in damage")}


def test_substation_ids(spark):
    got = one(spark, a=text.substation_parts(F.lit("P1Uhs12_1247")), b=text.substation_parts(F.lit("other")))
    assert tuple(got["a"]) == ("P1U", "p1uhs12", 12.47) and got["b"] is None


def test_settings_name_all_faults():
    required = {"a": (0.0, 1.0), "b": (1.0, 5.0)}
    assert support.validate_settings({"a": 0.5, "b": 2}, required) == {"a": 0.5, "b": 2}
    with pytest.raises(ValueError, match="b is missing; c isn't known; a must be"):
        support.validate_settings({"a": True, "c": 1}, required)


def test_store_runs_out(spark):
    df = spark.createDataFrame([(1, 0, 50.0, 5.0), (1, 1, 60.0, 8.0), (1, 2, 10.0, 9.0)], "k int, i int, p double, end double")
    rows = sorted(support.finite_support(df, ["k"], "i", "p", F.lit(80.0), "end").collect(), key=lambda r: r.i)
    assert [r.used for r in rows] == [50.0, 30.0, 0.0] and rows[1].fraction == 0.5 and {r.depleted_h for r in rows} == {8.0}


def test_histories_are_sums_of_keyed_cycles(spark, monkeypatch):
    from gridmend.functions.draws import uniform_of

    monkeypatch.setattr(renewal, "ROUND", 3)  # so that units go through many rounds
    units = spark.createDataFrame([(s, u) for s in (1, 2) for u in range(4)], "site int, unit int")
    got = {}
    for r in renewal.equipment_events(units, ["site"], 900.0, 5, mttf=40.0, mttr=9.0, fail_to_start=0.2, ready=0.5, available=0.5, accept=0.25).collect():
        got.setdefault(r.site, []).append((round(r.t, 6), r.d))
    for site in (1, 2):
        want = []
        for unit in range(4):
            u = lambda *key: uniform_of(5, site, unit, *key)  # noqa: B023, E731
            now, n = 0.5 if u("available") < 0.5 else max(0.5, -9 * np.log(u("first")) + 0.25), 0
            while now < 900:
                ran = -40 * np.log(u(n, "run")) if u(n, "start") >= 0.2 else 0.0
                want += [(round(t, 6), d) for t, d in ((now, 1), (now + ran, -1)) if ran and t < 900]
                now, n = now + ran - 9 * np.log(u(n, "repair")) + 0.25, n + 1
        assert sorted(got[site]) == sorted(want) and len(want) > 50
    assert renewal.cycles(units.where("false"), F.lit(0.0), lambda n: F.lit(1.0), 5.0).count() == 0
    assert [r.n for r in renewal.cycles(units.where("site = 1 and unit = 0"), F.lit(0.0), lambda n: F.lit(1.0), 5.0).orderBy("n").collect()] == [0, 1, 2, 3, 4]


def test_histories_end_at_the_horizon_and_are_dealt_out(spark, monkeypatch):
    """A unit draws no cycles beyond the horizon, and units of one split are followed by many tasks."""
    written = []
    monkeypatch.setattr(renewal, "cut", lambda df, name: written.append(df) or df)
    units = spark.range(0, 64, numPartitions=1).select(F.col("id").alias("unit"))
    assert renewal.cycles(units, F.lit(0.0), lambda n: F.lit(4.0), 5.0).count() == 128
    (rows,) = written
    assert {r.n for r in rows.select(F.size("gm_begun").alias("n")).collect()} == {3}
    assert rows.rdd.getNumPartitions() > 1


def test_up_spans_are_the_steps_of_the_trace(spark):
    units = spark.range(0, 20).select(F.lit(1).alias("stage"), F.col("id").alias("unit"), F.lit(90.0).alias("mttf"), F.lit(30.0).alias("mttr"), F.lit(0.3).alias("q"))
    spans = renewal.up_spans(units, ["stage"], 300.0, 0.25, 4).groupBy("unit").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))
    steps = renewal.outage_trace(units, ["stage"], 300.0, 0.25, 4).groupBy("unit").agg(F.count_distinct("index").alias("n"))
    assert {tuple(r) for r in spans.collect()} == {tuple(r) for r in steps.collect()} != set()
