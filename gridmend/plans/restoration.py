"""Queries on outages, repairs, allocation and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import economics, graph, relational, scan, stats, support
from . import views as v
from .catalog import query
from .views import Tables

R = F.round


@query("G01 W07 E02 O04 X24", f"""with {v.TRAJECTORY}
select scenario, node, step_index, round(start_h, 6) as start_h, round(end_h, 6) as end_h, round(unserved_mw, 6) as unserved_mw,
  round(critical_mw, 6) as critical_mw, round(step_ens, 4) as step_ens, round(cum_ens, 4) as cum_ens
from trajectory""")
def restoration_trajectory(t: Tables) -> DataFrame:
    x = v.trajectory(t)
    return x.select("scenario", "node", F.col("step_index").cast("long").alias("step_index"), *(R(k, 6).alias(k) for k in ("start_h", "end_h", "unserved_mw", "critical_mw")), R("step_ens", 4).alias("step_ens"), R("cum_ens", 4).alias("cum_ens"))


@query("G01 G02 J13 A22", f"""with {v.LOADS}, {v.DAMAGE}
select scenario, round(sum(kw) / 1000, 8) as unserved_mw, round(sum(case when is_critical then kw else 0 end) / 1000, 8) as critical_mw,
  round(sum(kw * voll), 4) as voll_per_h, count(*) as n_loads, count(distinct node) as n_islands
from damage join loads using (node) group by scenario""")
def unserved_by_scenario(t: Tables) -> DataFrame:
    m = graph.outage_metrics(graph.tree_unserved(v.damage(t), v.loads(t)))
    return m.select("scenario", R("unserved_mw", 8).alias("unserved_mw"), R("critical_mw", 8).alias("critical_mw"), R("voll_per_h", 4).alias("voll_per_h"), "n_loads", "n_islands")


@query("G04 G06 G10 G11", f"""with {v.DAMAGE}, hit as (select scenario, node from damage), runs as (
  select scenario, node, node - row_number() over (partition by scenario order by node) as run from hit)
select scenario, node, min(node) over (partition by scenario, run) as component, count(*) over (partition by scenario, run) as size from runs""")
def outage_islands(t: Tables) -> DataFrame:
    """Components of the damaged nodes of each scenario, neighbours by number; all scenarios are solved at once."""
    nodes = v.damage(t).select("scenario", "node")
    after = nodes.select("scenario", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    edges = after.join(nodes.select("scenario", F.col("node").alias("b")), ["scenario", "b"])
    found = graph.components(nodes, edges, ["scenario"])
    size = found.groupBy("scenario", "component").agg(F.count("*").alias("size"))
    return found.join(size, ["scenario", "component"]).select("scenario", "node", "component", "size")


@query("G03 G01 J15 U04", f"""with {v.DAMAGE}, cases as (select distinct scenario from damage)
select scenario, 'source' as node from cases union all
select scenario, 'region ' || r_regionkey from cases, region union all
select scenario, 'nation ' || n_nationkey from cases, nation where not exists (select 1 from damage d where d.scenario = cases.scenario and d.node = n_nationkey)""")
def source_reachability(t: Tables) -> DataFrame:
    """What the source still reaches in each scenario, all scenarios in the bits of masks."""
    named = lambda kind, key: F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))
    top = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("edge_id"), F.lit("source").alias("a"), named("region", "r_regionkey").alias("b"))
    low = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("edge_id"), named("region", "n_regionkey").alias("a"), named("nation", "n_nationkey").alias("b"))
    hit = v.damage(t).select("scenario", F.concat(F.lit("n"), F.col("node").cast("string")).alias("edge_id"))
    return graph.reachable_in_cases(top.unionByName(low), hit, t.spark.createDataFrame([("source",)], "node string"))


@query("W13 O04 J24", f"""with {v.LOADS}, caps as (select node, 0.25 * sum(kw) as cap from loads group by node),
asked as (select load_id, node, kw, cap, coalesce(sum(kw) over (partition by node order by is_critical desc, voll desc, kw desc, load_id rows between unbounded preceding and 1 preceding), 0) as before from loads join caps using (node))
select load_id, node, round(greatest(0, least(kw, cap - before)), 6) as given from asked""")
def waterfall_allocation(t: Tables) -> DataFrame:
    loads = v.loads(t)
    caps = loads.groupBy("node").agg((0.25 * F.sum("kw")).alias("cap"))
    order = [F.desc("is_critical"), F.desc("voll"), F.desc("kw"), F.col("load_id")]
    out = scan.waterfall(loads.join(caps, "node"), ["node"], "kw", F.col("cap"), order)
    return out.select("load_id", "node", R("given", 6).alias("given"))


@query("W13 O04 X21 (legacy order)", f"""with {v.LOADS}, ranked as (select load_id, kw, coalesce(sum(kw) over (partition by r order by is_critical desc, voll desc, kw desc, node desc, load_id desc rows between unbounded preceding and 1 preceding), 0) as before, r
  from (select *, node % 5 as r from loads))
select load_id, r, round(greatest(0, least(kw, 15000 - before)), 6) as given from ranked""")
def pooled_allocation(t: Tables) -> DataFrame:
    """The older order: ties go to the larger zone and id, and a cap that is left over is simply unused."""
    loads = v.loads(t).withColumn("r", F.col("node") % 5)
    order = [F.desc("is_critical"), F.desc("voll"), F.desc("kw"), F.desc("node"), F.desc("load_id")]
    return scan.waterfall(loads, ["r"], "kw", F.lit(15000.0), order).select("load_id", "r", R("given", 6).alias("given"))


@query("W09 W10", f"""with {v.TRAJECTORY}
select scenario, round(min(case when service >= 0.5 - 1e-10 then start_h end), 6) as t50, round(min(case when service >= 0.9 - 1e-10 then start_h end), 6) as t90,
  round(coalesce(min(case when service >= 0.9 - 1e-10 then start_h end), max(end_h)), 6) as t90_or_end
from trajectory group by scenario""")
def first_passage_t50_t90(t: Tables) -> DataFrame:
    x = v.trajectory(t)
    found = relational.first_passage(x, ["scenario"], "start_h", "service", {"t50": 0.5, "t90": 0.9})
    ends = x.groupBy("scenario").agg(F.max("end_h").alias("end_h"))
    return found.join(ends, "scenario").select("scenario", R("t50", 6).alias("t50"), R("t90", 6).alias("t90"), R(F.coalesce("t90", "end_h"), 6).alias("t90_or_end"))


@query("J16 ST03 A09", f"""with {v.TRAJECTORY}, grid as (select scenario, cast(h as double) as hour from (select distinct scenario from trajectory), range(0, 49, 4) g(h)),
met as (select g.scenario, g.hour, (select x.service from trajectory x where x.scenario = g.scenario and x.start_h <= g.hour order by x.start_h desc limit 1) as service from grid g)
select cast(hour as integer) as hour, count(*) as n, round(avg(service), 6) as mean, round(quantile_cont(service, 0.25), 6) as q25, round(quantile_cont(service, 0.75), 6) as q75 from met group by hour""")
def hourly_curve_asof(t: Tables) -> DataFrame:
    c = stats.hourly_curves(v.trajectory(t), [], "scenario", "start_h", "service", 48, 4)
    return c.select("hour", "n", R("mean", 6).alias("mean"), R("q25", 6).alias("q25"), R("q75", 6).alias("q75"))


@query("J18 A28 U07 W16", f"""with {v.VISITS}, points as (select user_id, start as t, 1 as d from visits union all select user_id, "end", -1 from visits),
steps as (select user_id, t, sum(d) as d from points group by 1, 2),
cut as (select user_id, t as start, lead(t) over (partition by user_id order by t) as stop, sum(d) over (partition by user_id order by t) as online from steps)
select user_id, round(sum(case when online > 0 then stop - start else 0 end), 5) as union_time, round(sum(online * (stop - start)), 5) as total_time from cut where stop is not null group by user_id""")
def interval_refine_union_time(t: Tables) -> DataFrame:
    u = relational.union_time(v.visits(t), ["user_id"])
    return u.select("user_id", R("union_time", 5).alias("union_time"), R("total_time", 5).alias("total_time"))


@query("A29", f"""with {v.VISITS}, days as (select distinct user_id, unnest(range(cast(floor(start / 24) as bigint), cast(ceil("end" / 24) as bigint))) as day from visits where "end" > start)
select user_id, count(*) as loss_days from days group by user_id""")
def loss_days(t: Tables) -> DataFrame:
    x = v.visits(t).where("end > start")
    day = F.explode(F.sequence(F.floor(F.col("start") / 24), F.ceil(F.col("end") / 24) - 1))
    return x.select("user_id", day.alias("day")).distinct().groupBy("user_id").agg(F.count("*").alias("loss_days"))


@query("J17", f"""with {v.TRAJECTORY}, mid as (select scenario, max(end_h) / 2 as t from trajectory group by scenario)
select m.scenario, step_index, node from mid m join trajectory x on x.scenario = m.scenario and x.start_h <= m.t and m.t < x.end_h""")
def interval_of_midpoint(t: Tables) -> DataFrame:
    """The repair that goes on halfway through each scenario: half-open intervals, so exactly one."""
    x = v.trajectory(t)
    mid = x.groupBy("scenario").agg((F.max("end_h") / 2).alias("t"))
    return x.join(mid, "scenario").where("start_h <= t and t < end_h").select("scenario", F.col("step_index").cast("long").alias("step_index"), "node")


@query("E02 E06 F05 F06 A08 P19", f"""with {v.LOADS}, {v.DAMAGE}, hit as (select scenario, load_id, kw, load_type, is_critical, repair_h * kw as kwh, repair_h from damage join loads using (node)),
cost as (select *, case when is_critical then kwh * 100.0 else kw * (case when load_type = 'residential' then 10.0 else 25.0 end) * (case when repair_h <= 24 then repair_h else 24 end) end as damage from hit)
select scenario, round(sum(case when is_critical then damage else 0 end), 6) as critical_damage, round(sum(case when not is_critical and load_type = 'commercial' then damage else 0 end), 6) as commercial_damage,
  round(sum(case when not is_critical and load_type = 'residential' then damage else 0 end), 6) as residential_damage, round(sum(damage), 6) as total_damage from cost group by scenario""")
def economic_segments(t: Tables) -> DataFrame:
    hit = v.damage(t).join(v.loads(t), "node").withColumn("kwh", F.col("repair_h") * F.col("kw"))
    cost = hit.withColumn("damage", economics.load_damage(F.col("kwh"), F.col("kw"), F.col("load_type"), F.col("is_critical")))
    s = economics.segments(cost, ["scenario"])
    return s.select("scenario", *(R(k, 6).alias(k) for k in s.columns if k != "scenario"))


@query("X22 O02 O03", f"""with {v.LOADS}, {v.DAMAGE}, {v.NODE_POWER}, scored as (select scenario, node, kw / 1000 as gain, repair_h, row_number() over (partition by scenario order by kw desc, repair_h, node desc) as place from damage join node_power using (node))
select scenario, node, place, round(gain, 6) as gain, round(gain / greatest(repair_h, 0.1), 6) as gain_per_hour from scored where place <= 5""")
def candidate_screen(t: Tables) -> DataFrame:
    """The five repairs of a scenario that bring back most load; shorter ones first among equals."""
    met = v.damage(t).join(v.node_power(t), "node")
    place = F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("kw"), "repair_h", F.desc("node")))
    best = met.withColumn("place", place.cast("long")).where("place <= 5")
    gain = F.col("kw") / 1000
    return best.select("scenario", "node", "place", R(gain, 6).alias("gain"), R(gain / F.greatest("repair_h", F.lit(0.1)), 6).alias("gain_per_hour"))


@query("X20 X25 W11", f"""with {v.TRAJECTORY}, p as (select scenario, step_index, end_h, least(15.0, unserved_mw) * duration_h as potential from trajectory),
b as (select *, coalesce(sum(potential) over (partition by scenario order by step_index rows between unbounded preceding and 1 preceding), 0) as before from p),
u as (select *, least(potential, greatest(0, 180 - before)) as used, greatest(0, 180 - before - potential) as remaining from b)
select scenario, round(sum(used), 6) as used, round(min(remaining), 6) as remaining, round(min(case when remaining <= 1e-9 then end_h end), 6) as depleted_h from u group by scenario""")
def finite_energy_support(t: Tables) -> DataFrame:
    """Support of 15 MW for 12 hours along each scenario's repairs."""
    x = v.trajectory(t).withColumn("potential", F.least(F.lit(15.0), F.col("unserved_mw")) * F.col("duration_h"))
    s = support.finite_support(x, ["scenario"], "step_index", "potential", support.Resource("E12", 1.0, 12.0).energy(F.lit(15.0)), "end_h")
    return s.groupBy("scenario").agg(R(F.sum("used"), 6).alias("used"), R(F.min("remaining"), 6).alias("remaining"), R(F.max("depleted_h"), 6).alias("depleted_h"))


@query("J03 J09 T05", f"""with {v.EPISODES}, r as (select scenario, subset, sum(damage) as damage, sum(ens) as ens from episodes group by 1, 2)
select a.scenario, a.subset, round(100 * (b.damage - a.damage) / b.damage, 6) as damage_reduction_pct, round(100 * (b.ens - a.ens) / b.ens, 6) as ens_reduction_pct from r a join r b on a.scenario = b.scenario and b.subset = 'N' and a.subset <> 'N'""")
def resource_benefit(t: Tables) -> DataFrame:
    runs = v.episodes(t).groupBy("scenario", "subset").agg(F.sum("damage").alias("damage"), F.sum("ens").alias("ens"))
    x = support.resource_benefit(runs, ["scenario"], "subset", "N", ["damage", "ens"])
    return x.select("scenario", "subset", R("damage_reduction_pct", 6).alias("damage_reduction_pct"), R("ens_reduction_pct", 6).alias("ens_reduction_pct"))


@query("A24 J24 F30", """select s_nationkey as node, round(avg(s_acctbal), 6) as centre_x, round(avg(s_suppkey), 6) as centre_y, min(s_acctbal) as min_x, max(s_acctbal) as max_x, min(s_suppkey) as min_y, max(s_suppkey) as max_y from supplier group by 1""")
def node_extent(t: Tables) -> DataFrame:
    x = support.extent(t.supplier.withColumnRenamed("s_nationkey", "node"), ["node"], "s_acctbal", "s_suppkey")
    return x.select("node", R("centre_x", 6).alias("centre_x"), R("centre_y", 6).alias("centre_y"), "min_x", "max_x", "min_y", "max_y")


@query("M02 J11", """select o_orderkey, case when p is null then 'value is missing' else 'value shouldn''t be there' end as rule from (select o_orderkey, case when o_orderkey % 50 > 0 then o_totalprice end as p, o_orderstatus from orders) where (p is null) <> (o_orderstatus = 'P')""")
def hazard_null_contract(t: Tables) -> DataFrame:
    x = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 50 > 0, F.col("o_totalprice")).alias("p"), "o_orderstatus")
    return support.null_contract(x, "p", "o_orderstatus", "P", ["o_orderkey"])


@query("P14 B09", """select p_partkey, round(p_size * 1.3, 6) as facility_mw, round(p_size * 1.3 - p_size, 6) as cooling_mw, cast(ceil(p_size * 1.3 / 2.725) + 2 as bigint) as backup_units, round((ceil(p_size * 1.3 / 2.725) + 2) * 2.725, 6) as backup_mw from part""")
def facility_sizes(t: Tables) -> DataFrame:
    x = support.facility_size(F.col("p_size").cast("double"), 1.3, 2.725, 2)
    return t.part.select("p_partkey", R(x["facility_mw"], 6).alias("facility_mw"), R(x["cooling_mw"], 6).alias("cooling_mw"), x["backup_units"].cast("long").alias("backup_units"), R(x["backup_mw"], 6).alias("backup_mw"))
