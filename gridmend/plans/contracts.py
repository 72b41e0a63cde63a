"""Queries that look for faults, over tables with planted ones, and small parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from ..functions import scalar as s
from ..functions.draws import uniform
from ..operators import checks, hazard, supply, testbed
from ..operators.scratch import scratch_path
from ..sources import files
from . import views as v
from .catalog import query
from .simulated import uniform_sql
from .views import Tables

R = F.round


@query("Q01 (units of groups)", "select p_partkey as unit_group, p_size as capacity_mw, unnest(range(1, cast(p_size % 4 + 2 as bigint))) as unit from part")
def fleet_units(t: Tables) -> DataFrame:
    groups = t.part.select(F.col("p_partkey").alias("unit_group"), (F.col("p_size") % 4 + 1).alias("count"), F.col("p_size").alias("capacity_mw"), F.lit(0.1).alias("forced_outage_rate"))
    return supply.expanded_fleet(groups).select("unit_group", "capacity_mw", F.col("unit").cast("long").alias("unit"))


@query("Q06 (rates that don't agree)", "select p_partkey as unit_group from part where p_partkey % 9 = 0")
def rate_mismatches(t: Tables) -> DataFrame:
    """Outage rates that aren't the share of repair in a cycle: every ninth is off by a hundredth."""
    mttr = F.col("p_size").cast("double")
    groups = t.part.select(F.col("p_partkey").alias("unit_group"), F.lit(950.0).alias("mttf_hours"), mttr.alias("mttr_hours"), (mttr / (950 + mttr) + F.when(F.col("p_partkey") % 9 == 0, 0.01).otherwise(0.0)).alias("forced_outage_rate"))
    return supply.availability_mismatch(groups).select("unit_group")


@query("H13 (drawn states)", f"""with x as (select s_suppkey, {uniform_sql("'23|' || s_suppkey")} as u, s_suppkey % 4 / 10.0::double as a, s_suppkey % 5 / 20.0::double as b from supplier)
select s_suppkey, case when u < a then 'none' when u < a + b then 'moderate' when u < a + b + 0.25 then 'severe' else 'complete' end as state from x""")
def drawn_states(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    p = {"p_none": k % 4 / 10.0, "p_moderate": k % 5 / 20.0, "p_severe": F.lit(0.25), "p_complete": F.lit(1.0)}
    return t.supplier.select(k, hazard.drawn_state(uniform(23, k), p).alias("state"))


@query("T02 (planted faults)", f"""with {v.TRAJECTORY}, n as (select scenario, count(*) as n from trajectory group by scenario)
select scenario, 'number of steps' as rule from n where scenario % 5 = 0 union all select scenario, 'energy adds up' from n where scenario % 7 = 0
union all select scenario, 'steps are contiguous' from n where scenario % 11 = 0 and n > 1""")
def step_faults(t: Tables) -> DataFrame:
    """Episodes that promise a step too many, or an energy that their steps don't have, and steps that start late."""
    x = v.trajectory(t)
    planted = lambda k, y, otherwise: F.when(F.col("scenario") % k == 0, y).otherwise(otherwise)
    episodes = x.groupBy("scenario").agg(F.count("*").alias("n"), F.sum("step_ens").alias("e")).select("scenario", planted(5, F.col("n") + 1, F.col("n")).alias("n_steps"), planted(7, F.col("e") * 1.01 + 1, F.col("e")).alias("ens"))
    late = F.when((F.col("scenario") % 11 == 0) & (F.col("step_index") == 1), F.col("start_h") + 0.5).otherwise(F.col("start_h"))
    steps = x.select("scenario", "step_index", late.alias("start"), F.col("end_h").alias("end"), "step_ens")
    return checks.step_violations(episodes, steps, ["scenario"])


@query("T09 (cases)", """select cast(c_custkey as varchar) as id, 'unknown end ' || (1000000 + c_custkey) as rule from customer where c_custkey % 40 = 0 union all select cast(c_custkey as varchar), 'edge id repeats' from customer where c_custkey % 30 = 0""")
def case_faults(t: Tables) -> DataFrame:
    """Edges with an end that isn't there, and edges given twice."""
    k = F.col("c_custkey")
    edges = t.customer.select(k.alias("edge_id"), k.alias("a"), F.when(k % 40 == 0, 1_000_000 + k).otherwise(k).alias("b"))
    twice = t.customer.where(k % 30 == 0).select(k.alias("edge_id"), k.alias("a"), k.alias("b"))
    return checks.case_violations(edges.unionByName(twice), t.customer.select(k.alias("node"))).distinct()


@query("T09 (repair sequences)", f"""with {v.DAMAGE}, d as (select scenario, count(*) as n from damage group by 1)
select scenario, 'only in damage' as rule from d where scenario % 3 = 0 union all select scenario, 'only in order' from d where scenario % 4 = 0 union all select scenario, 'places or edges repeat' from d where scenario % 3 = 0 and scenario % 4 <> 0 and n > 1""")
def sequence_faults(t: Tables) -> DataFrame:
    """Orders that leave out their first repair, or name one that isn't needed."""
    x = v.trajectory(t).select("scenario", F.col("step_index").cast("long").alias("place"), F.col("node").alias("edge_id"))
    damaged = x.select("scenario", "edge_id")
    last = x.groupBy("scenario").agg(F.count("*").alias("n"))
    extra = last.where("scenario % 4 = 0").select("scenario", F.when(F.col("scenario") % 3 == 0, F.lit(0)).otherwise(F.col("n")).cast("long").alias("place"), F.lit(-1).cast("long").alias("edge_id"))
    orders = x.where("not (scenario % 3 = 0 and place = 0)").unionByName(extra)
    return checks.sequence_violations(orders, damaged, "scenario")


@query("X04 X15 (planted faults)", "select o_orderkey, 'on' as treatment, 'avoided energy is exported energy' as rule from orders where o_orderkey % 13 = 0 union all select o_orderkey, 'on', 'same repairs' from orders where o_orderkey % 17 = 0 union all select o_orderkey, 'on', 'critical energy isn''t worse' from orders where o_orderkey % 19 = 0")
def pair_faults(t: Tables) -> DataFrame:
    """Pairs of runs that avoid more than they export, differ in their repairs, or make critical loads worse."""
    k = F.col("o_orderkey")
    planted = lambda n, x: F.when(k % n == 0, x).otherwise(0)
    off = t.orders.select(k, F.lit("off").alias("treatment"), F.lit(100.0).alias("ens"), F.lit(30.0).alias("critical_ens"), F.lit(0.0).alias("exported"), F.lit(1).alias("order_hash"))
    on = t.orders.select(k, F.lit("on").alias("treatment"), F.lit(90.0).alias("ens"), (30.0 + planted(19, 1)).alias("critical_ens"), (10.0 - planted(13, 2)).alias("exported"), (1 + planted(17, 1)).alias("order_hash"))
    return checks.paired_violations(off.unionByName(on), ["o_orderkey"], "treatment", "off")


@query("X04 (ledger rows)", "select o_orderkey, 'fuel' as rule from orders where o_orderkey % 23 = 0")
def ledger_faults(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(k, F.lit(9.0).alias("start"), F.lit(2.0).alias("delivered"), (F.lit(4.0) + F.when(k % 23 == 0, 0.5).otherwise(0.0)).alias("burnt"), F.lit(7.0).alias("end"))
    return checks.balance_violations(rows, ["o_orderkey"], {"fuel": [("start", 1), ("delivered", 1), ("burnt", -1), ("end", -1)]})


@query("P03 (boolean forms)", "select p_partkey, p_partkey % 2 = 0 as strict, p_partkey % 7 in (0, 1, 2, 3, 4) as extended from part")
def boolean_forms(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    strict = F.when(k % 4 == 0, " TRUE").when(k % 4 == 1, "0").when(k % 4 == 2, "1").otherwise("False ")
    words = F.element_at(F.array(*(F.lit(x) for x in ("y", "T", "yes", "2.5", "-1", "0.0", "no"))), (k % 7 + 1).cast("int"))
    return t.part.select(k, s.strict_boolean(strict).alias("strict"), s.extended_boolean(words).alias("extended"))


@query("F23 F24 (bus references)", "select s_suppkey, 'b' || s_nationkey as bus, case s_suppkey % 3 when 0 then '' when 1 then '1,2,3' else '2' end as phases from supplier")
def bus_references(t: Tables) -> DataFrame:
    ref = F.concat(F.lit("b"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, ".1.2.3").otherwise(".2.x"))
    return t.supplier.select("s_suppkey", s.bus_name(ref).alias("bus"), F.array_join(s.bus_phases(ref), ",").alias("phases"))


@query("F19 S11 (lists in text)", """select s_suppkey, case when s_suppkey % 5 = 0 then 0 else 3 end as n, case when s_suppkey % 5 = 0 then '[]' else '["' || least('a', cast(s_nationkey as varchar)) || '","' || greatest('a', cast(s_nationkey as varchar)) || '"]' end as canonical from supplier""")
def json_lists(t: Tables) -> DataFrame:
    """Lists written as JSON in a text: parsed, and written again sorted and without repeats; what isn't a list is empty."""
    name = F.col("s_nationkey").cast("string")
    said = F.when(F.col("s_suppkey") % 5 == 0, "not a list").otherwise(F.concat(F.lit('["'), name, F.lit('","a","'), name, F.lit('"]')))
    found = s.json_list(said)
    return t.supplier.select("s_suppkey", F.size(found).alias("n"), s.json_sorted(found).alias("canonical"))


@query("S21 (canonical digests)", """select n_nationkey, sha256('{"name":"' || n_name || '","region":' || n_regionkey || '}') as digest from nation""")
def canonical_digests(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.canonical_digest(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("digest"))


@query("P06 P07 (nodes)", """select s_suppkey, s_suppkey % 4 in (0, 1) as eligible, case when s_suppkey % 4 in (0, 1) then 'substation' when s_suppkey % 4 = 2 then 'data_center_facility' else 'not_applicable' end as component from supplier""")
def node_classes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    c = classify.node_component(F.when(k == 0, True), F.when(k == 1, "Substation_Interface").otherwise("bus"), k == 2, ["substation"])
    return t.supplier.select("s_suppkey", c["eligible"].alias("eligible"), c["component"].alias("component"))


@query("S11 (whole documents)", "select n_regionkey as region, count(*) as n, min(n_name) as first from nation group by 1")
def json_documents(t: Tables) -> DataFrame:
    """A document of several lines for each region."""
    path = scratch_path(t.spark, "documents")
    body = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))  # 25 nations
    lines = F.concat(F.lit('{\n  "region": '), F.col("n_regionkey").cast("string"), F.lit(',\n  "names": '), F.to_json("names"), F.lit("\n}"))
    body.select(lines.alias("value"), F.col("n_regionkey").alias("part")).repartition("part").write.partitionBy("part").text(path)
    x = files.read_json(t.spark, f"{path}/*/*.txt", "region long, names array<string>")
    return x.select("region", F.size("names").cast("long").alias("n"), F.get("names", F.lit(0)).alias("first"))


@query("S22 (manifests)", "select cast(n_nationkey as varchar) as name, case n_nationkey % 5 when 0 then 'file isn''t listed' when 1 then 'content differs' end as rule from nation where n_nationkey % 5 < 2 union all select '../etc', 'name leaves the folder' union all select 'lost', 'file is missing'")
def manifest_faults(t: Tables) -> DataFrame:
    """A file for each nation; the manifest lacks some, has other digests for some, and names two that aren't there."""
    path = scratch_path(t.spark, "listed")
    k = F.col("n_nationkey")
    t.nation.select("n_name", k).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = files.digests(t.spark, path).select("name", F.regexp_extract("name", r"n_nationkey=(\d+)", 1).cast("long").alias("id"), "sha256").where("name not like '%_SUCCESS'")
    listed = found.where("id % 5 > 0").select("name", F.when(F.col("id") % 5 == 1, "0").otherwise(F.col("sha256")).alias("sha256"))
    planted = t.spark.createDataFrame([("../etc", "0"), ("lost", "0")], listed.schema)
    x = files.manifest_violations(t.spark, path, listed.unionByName(planted))
    return x.join(found.select("name", "id"), "name", "left").select(F.coalesce(F.col("id").cast("string"), "name").alias("name"), "rule")


@query("S27 (stripped base)", "select c_custkey as load_id, c_nationkey as node from customer where c_custkey % 6 > 0")
def stripped_base(t: Tables) -> DataFrame:
    """A case without what an overlay owns; rows that don't say so belong to the case."""
    k = F.col("c_custkey")
    base = t.customer.select(k.alias("load_id"), F.col("c_nationkey").alias("node"), F.when(k % 6 == 0, True).when(k % 6 == 1, False).alias("is_data_center"), "c_name")
    return testbed.stripped(base, "is_data_center", ["load_id", "node"])
