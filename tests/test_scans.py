"""Scans and quantiles over ranges against loops over whole groups, with groups that fill many ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmend.operators import learning, publish, quantiles, resampling, scan, tensors


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    return [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", i, round(rng.random() * 9, 3)) for i in range(1500)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, i int, x double").repartition(5)


def groups(rows):
    out = {}
    for g, i, x in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((i, x))
    return out


def test_sums_before(spark, rows):
    got = scan.sums_before(scan.placed(frame(spark, rows), ["g"], ["i"]), ["g"], {"s": F.col("x"), "n": F.lit(1)})
    assert got.columns == ["g", "i", "x", "gm_at", "s", "n"]
    found = {r.i: (r.s, r.n) for r in got.collect()}
    for items in groups(rows).values():
        for n, (i, _) in enumerate(items):
            assert found[i] == (pytest.approx(sum(x for _, x in items[:n])), n)
    assert got.select(F.shiftright("gm_at", 33)).distinct().count() == 4  # the hot group lies in several ranges


def test_waterfall_over_ranges(spark, rows):
    got = {r.i: r.given for r in scan.waterfall(frame(spark, rows), ["g"], "x", F.lit(700.0), [F.desc("i")]).collect()}
    for items in groups(rows).values():
        left = 700.0
        for i, x in items[::-1]:
            given = min(x, max(0.0, left))
            assert got[i] == pytest.approx(given, abs=1e-9)
            left -= x
    nulls = spark.createDataFrame([(1, 1, None), (1, 2, 5.0)], "g int, i int, x double")
    assert sorted(r.given for r in scan.waterfall(nulls, ["g"], "x", F.lit(3.0), ["i"]).collect()) == [0.0, 3.0]


@pytest.mark.parametrize(("cap", "least"), [(40.0, 0), (3.0, 2), (0.0, 0), (1e9, 0), (500.0, 5)])
def test_taking_under_a_cap(spark, rows, cap, least):
    rows = [(g, i, float(round(x))) for g, i, x in rows]
    got = sorted((r.g or "", r.i) for r in scan.take_under_cap(frame(spark, rows), ["g"], "x", cap, ["i"], least).collect())
    want = []
    for g, items in groups(rows).items():
        total, n = 0.0, 0
        for i, x in items:
            if total + x <= cap or n < least:
                total, n = total + x, n + 1
                want.append((g or "", i))
    assert got == sorted(want)


def test_affine_maps_compose(spark, rows):
    placed = scan.placed(frame(spark, rows), ["g"], ["i"])
    for spans in ((4, 64), (256, 1 << 20), (1, 2)):
        got = {r.i: r.before for r in scan.affine_before(placed, ["g"], F.when(F.col("i") % 50 == 0, 0.0).otherwise(0.9), F.col("x"), 2.0, spans=spans).collect()}
        for items in groups(rows).values():
            state = 2.0
            for i, x in items:
                assert got[i] == pytest.approx(state)
                state = (0.0 if i % 50 == 0 else 0.9) * state + x


@pytest.mark.parametrize("lam", [0.95, 0.5, 0.0])
def test_advantages_are_those_of_the_recursion(spark, rows, lam):
    got = {r.i: r.advantage for r in learning.discounted_advantages(frame(spark, rows).withColumn("v", F.col("x") / 3), ["g"], "i", "x", "v", 0.9, lam).collect()}
    for items in groups(rows).values():
        run = after = 0.0
        for i, x in items[::-1]:
            run = x + 0.9 * after - x / 3 + 0.9 * lam * run
            after = x / 3
            assert got[i] == pytest.approx(run)


VALUES = {
    "few": [1.0, 2.0],
    "one": [7.0],
    "ties": [0.0] * 400 + [1.0] * 400,
    "mostly": [5.0] * 700 + list(range(60)),
    "wide": [(-1) ** k * 10.0 ** (k % 300) for k in range(900)],
    "plain": [float(k * 7919 % 1000) for k in range(1000)],
    "nothing": [None, float("nan")],
}


@pytest.mark.parametrize("few", [3, 50_000])
def test_quantiles_are_exact(spark, few):
    df = spark.createDataFrame([(g, x) for g, xs in VALUES.items() for x in [None if x is None else float(x) for x in xs]], "g string, x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.g: list(r)[1:] for r in quantiles.quantiles(df, ["g"], "x", shares, list("abcde"), few).collect()}
    assert got.pop("nothing") == [None] * 5
    for g, found in got.items():
        assert found == pytest.approx(np.quantile(np.array(VALUES[g], float), shares), rel=1e-12), g
    whole = quantiles.quantiles(df.where("g = 'plain'"), [], "x", [0.95], ["p"], few).collect()
    assert [r.p for r in whole] == [pytest.approx(np.quantile(VALUES["plain"], 0.95))]
    assert quantiles.quantiles(df.where("false"), [], "x", [0.5], ["p"]).collect()[0].p is None
    assert quantiles.quantiles(df.where("false"), ["g"], "x", [0.5], ["p"]).count() == 0


@pytest.mark.parametrize(("n", "size"), [(1, 4), (10, 4), (37, 4), (4096, 100)])
def test_draws_deal_exactly_n_rows(n, size):
    blocks = -(-n // size)
    counts = np.array([[resampling.dealt(n, b, size, 3, 8, d) for b in range(blocks)] for d in range(60)])
    assert (counts.sum(axis=1) == n).all()
    want = np.array([min(n, (b + 1) * size) - b * size for b in range(blocks)])
    assert np.abs(counts.mean(axis=0) - want).max() < 6 * np.sqrt(size / 60)


def test_fixed_size_bootstraps(spark):
    rng = np.random.default_rng(2)
    values = {"hot": rng.normal(10, 3, 900), "small": rng.normal(0, 1, 7), None: rng.normal(5, 1, 64)}
    rows = [(g, i, float(x)) for g, xs in values.items() for i, x in enumerate(xs)] + [("small", 99, None), ("none", 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    got = {(r.g, r.draw): r.mean for r in resampling.draw_means(df.repartition(7), ["g"], "x", ["i"], 50, 5, 64).collect()}
    group = {r.g: r.h for r in df.select("g", F.xxhash64(F.lit(0), "g").alias("h")).distinct().collect()}
    for g, xs in values.items():  # the same draws, block after block
        total = sum(resampling.block_sums(xs[b * 64 : (b + 1) * 64], len(xs), b, 64, 5, group[g], 50) for b in range(-(-len(xs) // 64)))
        assert [got[g, d] for d in range(50)] == pytest.approx(total / len(xs))
    assert len(got) == 150
    ends = {r.g: (r.low, r.high) for r in resampling.interval(df, ["g"], "x", ["i"], 400, 5, block=64).collect()}
    xs = values["hot"]
    wide = np.quantile([rng.choice(xs, len(xs)).mean() for _ in range(2000)], [0.025, 0.975])
    assert ends["hot"] == pytest.approx(tuple(wide), abs=0.06)


def test_edge_tensors_unpack_to_the_edges(spark):
    rng = random.Random(4)
    rows = [(s, rng.randint(0, 9), rng.randint(0, 9), rng.random(), None) for s in range(30) for _ in range(rng.randint(1, 20))] + [(5, None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s int, a int, b int, x double, y double")
    got = tensors.packed(df, "s", "a", "b", ["x", "y"], 4, 1000).collect()
    back = sorted(tuple(r) for r in tensors.unpacked(tensors.packed(df, "s", "a", "b", ["x", "y"], 4, 1000)).select("state", "a", "b", F.col("features")[0]).collect())
    assert back == sorted((s, a, b, x) for s, a, b, x, _ in rows if a is not None)
    assert all(len(r.mask) % 4 == 0 and len(r.mask) - 4 < r.n_edges == sum(r.mask) and r.nodes == sorted(r.nodes) for r in got)
    sizes = {}
    for r in got:
        sizes[r.batch] = sizes.get(r.batch, 0) + 25 * len(r.mask)
    assert len(sizes) > 3 and max(sizes.values()) < 1000 + 25 * 20


def test_publishing_is_all_or_nothing(spark, tmp_path):
    store = publish.Published(spark, f"file://{tmp_path}/p")
    with pytest.raises(ValueError, match="no table"):
        store.read("a")
    one = spark.createDataFrame([(1,)], "x int")
    assert store.append({"a": one, "b": one}) == 1
    with pytest.raises(Exception, match="stopped"):
        store.append({"a": one, "b": one.select(F.raise_error(F.lit("stopped")).alias("x"))})
    assert store.read("a").count() == 1 and store.append({"a": one}) == 2
    assert (store.read("a").count(), store.read("b").count()) == (2, 1)
    with pytest.raises(RuntimeError, match="another append"):
        store._commit(2, {})
    assert store.read("a").count() == 2


def test_rollups_agree_and_skip_nulls(spark):
    rows = [("a", 900 * k, float(k)) for k in range(200)] + [("a", 0, None), ("a", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, s long, x double").select("k", F.timestamp_seconds("s").alias("at"), "x")
    got = publish.rolled_up(df, "k", "at", "x").collect()
    assert {(r.resolution): sum(1 for q in got if q.resolution == r.resolution) for r in got} == {"quarter": 200, "hour": 50, "day": 3}
    assert all(sum(r.n * r.mean for r in got if r.resolution == name) == sum(range(200)) for name in publish.RESOLUTIONS)


def test_edge_tensors_sort_sizes_and_not_arrays(spark, monkeypatch):
    """Ranges are made of states' sizes alone; edges that are alike all stay, and one without a state is left out."""
    placed, real = [], tensors.scan.placed
    monkeypatch.setattr(tensors.scan, "placed", lambda rows, *more: placed.append(rows.columns) or real(rows, *more))
    rows = [(1, 7, 8, 2.0), (1, 7, 8, 2.0), (1, 7, 8, 1.0), (1, 8, 8, 3.0), (None, 1, 2, 1.0)]
    (r,) = tensors.packed(spark.createDataFrame(rows, "s int, a int, b int, x double"), "s", "a", "b", ["x"], 8).collect()
    assert placed == [["state", "gm_bytes"]]
    assert (r.nodes, r.source[:4], r.target[:4], [x for (x,) in r.features[:4]], sum(r.mask), len(r.mask)) == ([7, 8], [0, 0, 0, 1], [1, 1, 1, 1], [1.0, 2.0, 2.0, 3.0], 4, 8)
