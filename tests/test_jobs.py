"""Network jobs, event economics, stages, workbooks and pinned files on small cases worked out by hand."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmend.functions import plane, scalar
from gridmend.operators import economics, learning, network, relational, scratch, stages
from gridmend.sources import arrays, fetch, workbook


def test_network_between_protected_nodes(spark):
    # 1 - 2 - 3 (protected) - 4 - 5 (protected): 2 carries load, 4 doesn't; 6 hangs on 3 with a small load
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 5), (5, 3, 6), (6, 5, 7), (7, 7, 8), (8, 8, 9)], "edge_id int, a int, b int").withColumns({"is_switch": F.lit(False), "is_transformer": F.lit(False)})
    nodes = spark.createDataFrame([(i, 12.47) for i in range(1, 10)], "node int, kv double")
    loads = spark.createDataFrame([(1, 2, 80.0), (2, 6, 10.0), (3, 9, 5.0)], "load_id int, node int, kw double")
    kept = spark.createDataFrame([(1,), (3,), (5,)], "node int")
    parts, members, links = network.aggregated(nodes, edges, loads, kept)
    assert {(r.part, r.kind, r.n_nodes, r.kw) for r in parts.collect()} == {(2, "complex", 1, 80.0), (4, "corridor", 1, 0.0), (6, "merged_leaf", 1, 10.0), (7, "radial", 3, 5.0)}
    assert {r.node: r.target for r in members.collect()} == {1: 1, 2: 2, 3: 3, 4: None, 5: 5, 6: 3, 7: 7, 8: 7, 9: 7}
    assert {(r.a, r.b, r.edge_type) for r in links.collect()} == {(1, 2, "line"), (2, 3, "line"), (3, 5, "corridor"), (5, 7, "line")}


def test_protected_reasons(spark):
    edges = spark.createDataFrame([(1, 1, 2, False, False), (2, 1, 3, False, False), (3, 1, 4, True, False), (4, 4, 5, False, True)], "edge_id int, a int, b int, is_switch boolean, is_transformer boolean")
    nodes = spark.createDataFrame([(1, 12.0), (2, 0.4), (3, 0.4), (4, 115.0), (5, 12.0)], "node int, kv double")
    loads = spark.createDataFrame([(1, 2, 1.0), (2, 3, 90.0)], "load_id int, node int, kw double")
    got = {r.node: r.reasons for r in network.protected_nodes(nodes, edges, loads, spark.createDataFrame([(5,)], "node int")).collect()}
    assert got == {1: ["branch", "switch"], 3: ["load"], 4: ["switch", "transformer"], 5: ["root", "transformer"]}


def test_event_ledger_refuses_bad_pairs(spark):
    runs = [(1, "off", 7, 10.0, 5.0, 1.0, 0.0), (1, "on", 7, 6.0, 4.0, 1.0, 2.0), (2, "off", 8, 20.0, 5.0, 1.0, 0.0), (2, "on", 8, 10.0, 3.0, 0.0, 4.0)]
    schema = "scenario int, resource string, seed int, damage double, ens double, critical_ens double, support_mwh double"
    costs = spark.createDataFrame([(2.0, 20.0, 4.0, 10.0), (1.0, 10.0, 2.0, 5.0)], "support_mwh double, provider double, health double, climate double")
    r = economics.event_ledger(spark.createDataFrame(runs, schema), costs, "off", (True, False), False).first()
    assert (r.episodes, r.benefit, r.avoided_ens, r.support_mwh, r.full_cost, r.lifecycle_cost, r.host_externality) == (2, 7.0, 1.5, 3.0, 51.0, 36.0, 0.0)
    for bad in (runs[:3], [*runs, runs[1]], [*runs[:3], (2, "on", 9, 10.0, 3.0, 0.0, 4.0)]):
        with pytest.raises(Exception, match="no proper pair"):
            economics.event_ledger(spark.createDataFrame(bad, schema), costs, "off").collect()


def test_economic_summary_is_the_worked_example(spark):
    figures = economics.economic_summary(F.lit(400.0), F.lit(4.0), 0.1, 1, 2.0, 5.0, 100.0, 10.0)
    r = spark.range(1).select(*(x.alias(k) for k, x in figures.items())).first()
    assert (r.annualised_avoided_damage, r.annualised_cost, r.net_annual_value, r.npv) == pytest.approx((200.0, 130.0, 70.0, 700 / 11))


def test_paired_economics_is_that_of_long_rows(spark):
    """Rows with both treatments give what the long table gives, without a shuffle of them by load."""
    rows = [(s, i, 4.0 + i + s, 3.0 + i, 1.0 + i % 3, ("residential", "commercial")[i % 2], i % 5 == 0) for s in (1, 2) for i in range(20)]
    wide = spark.createDataFrame(rows, "scenario int, load_id int, off double, on double, kw double, load_type string, is_critical boolean")
    long = wide.select("*", F.explode(F.map_from_arrays(F.array(F.lit("off"), F.lit("on")), F.array("off", "on"))).alias("treatment", "kwh")).drop("off", "on")
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (economics.paired_economics(wide, ["scenario"], "off", "on"), economics.event_economics(long, ["scenario"], "off", "on")))
    assert len(got) == 2 and all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))
    with pytest.raises(Exception, match="lacks a treatment"):
        economics.paired_economics(wide.withColumn("on", F.when(F.col("load_id") > 3, F.col("on"))), ["scenario"], "off", "on").collect()
    plan = economics.paired_economics(wide, ["scenario"], "off", "on")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_event_economics_needs_both_treatments(spark):
    rows = [(1, 5, "off", 10.0, 2.0, "residential", False), (1, 5, "on", 6.0, 2.0, "residential", False), (1, 6, "off", 3.0, 1.0, "commercial", True)]
    df = spark.createDataFrame(rows, "scenario int, load_id int, treatment string, kwh double, kw double, load_type string, is_critical boolean")
    r = economics.event_economics(df.where("load_id = 5"), ["scenario"], "off", "on").first()
    assert (r.avoided_damage, r.residential_damage, r.export_mwh) == (40.0, 40.0, 0.004)
    with pytest.raises(Exception, match="lacks a treatment"):
        economics.event_economics(df, ["scenario"], "off", "on").collect()


def test_log_log_shape():
    assert economics.log_log(240.0, [24.0, 336.0, 720.0], [1.0, 6.0, 10.0]) == pytest.approx(math.exp(math.log(6) * math.log(10) / math.log(14)))
    with pytest.raises(ValueError):
        economics.log_log(10.0, [24.0, 48.0], [1.0, 2.0])


def test_normal_distribution(spark):
    xs = [-4.0, -1.5, -0.2, 0.0, 0.7, 2.2, 5.0]
    df = spark.createDataFrame([(math.exp(x),) for x in xs], "x double")
    got = [r.p for r in df.select(scalar.lognormal_cdf(F.col("x"), 0.0, 1.0).alias("p")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-7)


def test_forward_passes(spark):
    cells = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0)], "cy int, cx int, x double")
    got = {(r.cy, r.cx): r.x for r in learning.convolved(cells, [], "x", ((0, 0, 0), (0, 1, 0), (0, 0, 0.5)), 0.25, 2).collect()}
    assert got[0, 0] == 2.0 + 0.5 * 4.0 + 0.25 and got[1, 1] == 4.25
    scored = spark.createDataFrame([(1, 0.0, True), (1, 0.0, True), (1, 9.0, False)], "g int, s double, m boolean")
    assert sorted(r.p for r in learning.masked_softmax(scored, ["g"], "s", "m").collect()) == [0.0, 0.5, 0.5]


def test_nothing_is_written_unless_all_checks_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0)], "id int, x double")
    good = stages.Stage("a", {"table": lambda: df})
    bad = stages.Stage("b", {"other": lambda: df}, {"negative": lambda: df.where("x < 0")}, after=("a",))
    with pytest.raises(ValueError, match="b: negative: .*-1.0"):
        stages.run([good, bad], str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    assert [s.name for s in stages.ordered([bad, good], ["b"])] == ["a", "b"]
    assert spark.read.parquet(stages.run([good, bad], str(tmp_path / "out"), ["a"])["table"]).count() == 2
    with pytest.raises(ValueError, match="wait for each other"):
        stages.ordered([stages.Stage("a", {}, after=("b",)), stages.Stage("b", {}, after=("a",))])
    with pytest.raises(ValueError, match="no stage"):
        stages.ordered([good], ["z"])
    with pytest.raises(ValueError, match="given twice"):
        stages.registry([stages.Method("a", "A", "x", False), stages.Method("a", "B", "x", False)])


def test_workbooks(spark, tmp_path):
    rows = [[" a ", "b&c", None], ["x<y", 2.5, "drop"], [None, None, None], [" z", -1, None]]
    (tmp_path / "w.xlsx").write_bytes(workbook.workbook({"one": [["n"]], "two": rows}))
    got = workbook.read_sheet(spark, str(tmp_path / "w.xlsx"), "two", ["b&c", "a"]).collect()
    assert [(r.row, r["b&c"], r.a) for r in got] == [(0, "2.5", "x<y"), (2, "-1", " z")]
    with pytest.raises(ValueError, match="0 sheets"):
        list(workbook.sheet_rows(workbook.workbook({"one": []}), "two"))
    with pytest.raises(Exception, match="no columns"):
        workbook.read_sheet(spark, str(tmp_path / "w.xlsx"), "two", ["missing"]).collect()


def test_pinned_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("one\ntwo\n")
    made = fetch.export_bundle(spark, {"a.txt": str(tmp_path / "src" / "a.txt")}, str(tmp_path / "bundle")).first()
    item = {"name": "a.txt", "url": str(tmp_path / "bundle" / "a.txt"), "sha256": made.sha256}
    with pytest.raises(FileNotFoundError):
        fetch.fetch_pinned(spark, [item], str(tmp_path / "cache"), offline=True)
    with pytest.raises(ValueError, match="digests differ"):
        fetch.fetch_pinned(spark, [{**item, "sha256": "0"}], str(tmp_path / "cache"))
    assert not (tmp_path / "cache" / "a.txt").exists()
    assert fetch.fetch_pinned(spark, [item], str(tmp_path / "cache")).first().status == "fetched"
    assert fetch.fetch_pinned(spark, [item], str(tmp_path / "cache"), offline=True).first().status == "cached"
    assert fetch.list_prefixes(spark, str(tmp_path)) == ["bundle", "cache", "src"]
    assert fetch.line_counts(spark, str(tmp_path / "src")).first().n_lines == 2
    with pytest.raises(FileExistsError):
        fetch.export_bundle(spark, {}, str(tmp_path / "bundle"))
    with pytest.raises(ValueError, match="leave its folder"):
        fetch.safe_name("a/../../b")


def test_broadcasts_are_checked(spark):
    df = spark.range(50)
    assert "hint" in scratch.small(df, 50)._jdf.queryExecution().logical().toString().lower() and "hint" not in scratch.small(df, 49)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in scratch.small(df, 50, 10)._jdf.queryExecution().logical().toString().lower() and scratch.small(df, 50, 10).count() == 50


def test_arrays_and_shapes(spark, tmp_path):
    out = io.BytesIO()
    np.savez(out, a=np.arange(6).reshape(2, 3), b=np.array([7.5]), c=np.array(2))
    (tmp_path / "x.npz").write_bytes(out.getvalue())
    got = {(r.name, r.row): r["values"] for r in arrays.read_arrays(spark, str(tmp_path / "x.npz")).collect()}
    assert got == {("a", 0): [0.0, 1.0, 2.0], ("a", 1): [3.0, 4.0, 5.0], ("b", 0): [7.5], ("c", 0): [2.0]}
    hole = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (1.0, 2.0)]]
    (tmp_path / "s.zip").write_bytes(arrays.shapefile([({"N": "é"}, hole), ({"N": "longer"}, hole[:1])]))
    rows = arrays.read_shapes(spark, str(tmp_path / "s.zip"), ["N"]).collect()
    assert [(r.record, r.N, len(r.rings)) for r in rows] == [(1, "é", 2), (2, "longer", 1)] and rows[0].rings[1][2] == [2.0, 3.0]


def test_rings(spark):
    ring = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    cut = plane.clipped(ring, (2.0, -1.0, 9.0, 3.0))
    outside = plane.clipped(ring, (5.0, 5.0, 9.0, 9.0))
    r = spark.range(1).select(plane.area(cut).alias("a"), plane.centroid(cut)[0].alias("x"), plane.centroid(cut)[1].alias("y"), F.size(outside).alias("n"), *(c.alias(k) for k, c in zip("uv", plane.albers(F.lit(-96.0), F.lit(23.0)), strict=True))).first()
    assert (r.a, r.x, r.y, r.n) == pytest.approx((6.0, 3.0, 1.5, 0)) and (r.u, r.v) == pytest.approx((0.0, 0.0), abs=1e-6)
