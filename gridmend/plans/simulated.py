"""Queries over drawn histories and scenarios, held against recursive SQL over the same draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hazard, renewal
from . import views as v
from .catalog import query
from .views import Tables

R = F.round


def uniform_sql(label: str) -> str:
    """The number of draws.uniform for a label, an SQL expression."""
    return f"((cast('0x' || substr(sha256({label}), 1, 13) as bigint) + 0.5) / 4503599627370496.0)"


def _units(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("site"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("unit"))


AVAILABILITY = f"""units as (select s_suppkey as site, unit, '17|' || s_suppkey || '|' || unit || '|' as name from supplier, range(13) r(unit)),
tries(site, unit, name, n, tried, runs, off) as (
  select *, tried - 1100.0 * ln({uniform_sql("name || '0|run'")}) from (select *, {uniform_sql("name || '0|start'")} >= 0.0094 as runs from (
    select site, unit, name, cast(0 as bigint) as n, case when {uniform_sql("name || 'available'")} < 0.995 then 0.05::double else greatest(0.05::double, -37.3 * ln({uniform_sql("name || 'first'")}) + 0.01) end as tried from units)) where tried < 2000
  union all
  select *, tried - 1100.0 * ln({uniform_sql("name || n || '|run'")}) from (select *, {uniform_sql("name || n || '|start'")} >= 0.0094 as runs from (
    select site, unit, name, n + 1 as n, case when runs then off else tried end - 37.3 * ln({uniform_sql("name || n || '|repair'")}) + 0.01 as tried from tries where not runs or off < 2000)) where tried < 2000),
changes as (select site, tried as t, 1 as d from tries where runs union all select site, off, -1 from tries where runs and off < 2000 union all select s_suppkey, t, 0 from supplier, (values (0.0::double), (2000.0)) x(t)),
steps as (select site, t, sum(d) as d from changes group by site, t),
spans as (select site, t as start_h, lead(t) over w as end_h, sum(d) over w as online from steps window w as (partition by site order by t))"""


@query("X07 W16", f"with recursive {AVAILABILITY} select site, round(start_h, 6) as start_h, round(end_h, 6) as end_h, cast(online as bigint) as online from spans where end_h is not null")
def availability_intervals(t: Tables) -> DataFrame:
    """How many of thirteen units of each site are on over 2000 hours."""
    e = renewal.equipment_events(_units(t), ["site"], 2000.0, 17)
    return renewal.online_counts(e, ["site"], 2000.0).select("site", R("start_h", 6).alias("start_h"), R("end_h", 6).alias("end_h"), F.col("online").cast("long").alias("online"))


@query("X07 (units that never fail)", "select s_suppkey as site, 0.0::double as start_h, 0.05::double as end_h, cast(0 as bigint) as online from supplier union all select s_suppkey, 0.05::double, 100.0::double, 13 from supplier")
def ideal_availability(t: Tables) -> DataFrame:
    e = renewal.ideal_events(_units(t), ["site"], 100.0)
    return renewal.online_counts(e, ["site"], 100.0).select("site", "start_h", "end_h", F.col("online").cast("long").alias("online"))


@query("Q07", f"""with recursive units as (select cast(p_size % 3 as bigint) as stage, p_partkey as unit, '3|' || p_size % 3 || '|' || p_partkey || '|' as name from part),
x(stage, unit, name, n, began, up, off) as (
  select *, 0.0::double - case when up then 1100.0 else 37.3 end * ln({uniform_sql("name || '0'")}) from (select stage, unit, name, cast(0 as bigint) as n, 0.0::double as began, {uniform_sql("name || 'up'")} >= 0.03 as up from units)
  union all
  select *, began - case when up then 1100.0 else 37.3 end * ln({uniform_sql("name || n")}) from (select stage, unit, name, n + 1 as n, off as began, not up as up from x where off < 720)),
spans as (select stage, unit, cast(ceil(least(off, 720) / 0.25) - ceil(began / 0.25) as bigint) as quarters from x where up)
select stage, unit, cast(sum(quarters) as bigint) as quarters_up from spans where quarters > 0 group by all""")
def outage_trace(t: Tables) -> DataFrame:
    """In how many quarter-hours of a month each unit is up."""
    units = t.part.select((F.col("p_size") % 3).cast("long").alias("stage"), F.col("p_partkey").alias("unit"), F.lit(1100.0).alias("mttf"), F.lit(37.3).alias("mttr"), F.lit(0.03).alias("q"))
    up = renewal.up_spans(units, ["stage"], 720.0, 0.25, 3)
    return up.groupBy("stage", "unit").agg(F.sum(F.col("last") - F.col("first") + 1).alias("quarters_up"))


def _sampled(t: Tables) -> DataFrame:
    edges = t.supplier.select(F.col("s_suppkey").alias("edge_id"), F.col("s_nationkey").cast("long").alias("node"), (29.0 + F.col("s_suppkey") % 20 / 10.0).alias("lat"), (-96.0 + F.col("s_nationkey") / 10.0).alias("lon"), F.when(F.col("s_suppkey") % 7 == 0, "switch").otherwise("line").alias("kind"), (F.col("s_acctbal") / 5000).alias("length_km"))
    cases = t.region.select(F.col("r_regionkey").cast("long").alias("storm"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("mc"))
    grid = cases.select((F.col("storm") * 10 + F.col("mc")).alias("scenario"), F.lit(29.75).alias("lat"), (-95.4 + F.col("storm") / 10).alias("lon"), ((F.col("mc") - 2) * 20.0).alias("shift_km"), (0.8 + F.col("storm") / 10).alias("intensity"), F.lit(9.0).alias("base_mean"), (F.col("mc") == 1).alias("historical"))
    return hazard.sampled_scenarios(grid, edges, v.node_power(t), 19)


SAMPLED = f"""{v.LOADS}, {v.NODE_POWER},
edges as (select s_suppkey as edge_id, cast(s_nationkey as bigint) as node, 29.0::double + s_suppkey % 20 / 10.0::double as lat, -96.0::double + s_nationkey / 10.0::double as lon, case when s_suppkey % 7 = 0 then 0.5::double else 1.0 end as soft, greatest(0.03, least(3.5, s_acctbal / 5000)) as km from supplier),
cases as (select cast(r_regionkey as bigint) * 10 + mc as scenario, -95.4::double + r_regionkey / 10.0::double as eye, (mc - 2) * 20.0::double / 95 as shift, 0.8::double + r_regionkey / 10.0::double as intensity, mc = 1 as historical from region, range(1, 5) m(mc)),
cdf as (select scenario, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) over (partition by scenario order by k) as total from (select scenario, 9.0 * pow(intensity, 1.7) as lam from cases), range(200) r(k)),
drawn as (select scenario, sum((total < {uniform_sql("'19|' || scenario || '|edges'")})::int) as n from cdf group by scenario),
targets as (select c.*, greatest(greatest(5, least(42, n + floor({uniform_sql("'19|' || c.scenario || '|jitter'")} * 7) - 2)), case when historical then 0 else floor(12 + 8 * intensity) end) as target from cases c join drawn d on d.scenario = c.scenario),
tries as (select scenario, attempt, target + 6 * attempt as n, eye + shift as eye, intensity + 0.05 * greatest(0, attempt - 1) as strength from targets, range(4) a(attempt)),
near as (select t.*, e.*, pow(sin(radians(e.lat - 29.75) / 2), 2) + cos(radians(29.75)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - eye) / 2), 2) as h from tries t, edges e),
weighed as (select *, greatest(1e-8, (0.08 + exp(-0.5 * pow(2 * 6371.0 * atan2(sqrt(h), sqrt(greatest(0, 1 - h))) / (34 + 8 * strength), 2))) * soft * sqrt(km) * strength) as weight from near),
ranked as (select *, row_number() over (partition by scenario, attempt order by ln({uniform_sql("'19|' || scenario || '|' || attempt || '|' || edge_id")}) / weight desc, edge_id) as place from weighed),
picked as (select scenario, attempt, edge_id, node from ranked where place <= n),
dark as (select scenario, attempt, sum(kw) / 1000 as mw from (select distinct scenario, attempt, node from picked) join node_power using (node) group by all),
taken as (select scenario, coalesce(min(case when mw >= 5 and attempt < 3 then attempt end), 3) as attempt from tries left join dark using (scenario, attempt) group by scenario)"""


@query("H16 H17 H18", f"with {SAMPLED} select scenario, cast(attempt as integer) as attempt, edge_id, node from picked join taken using (scenario, attempt)")
def generated_scenarios(t: Tables) -> DataFrame:
    """Damaged edges of each scenario, near ones and long ones likelier, drawn again where too little is dark."""
    return _sampled(t).select("scenario", "attempt", "edge_id", "node")


@query("H16 (outages of drawn damage)", f"""with {SAMPLED}, hit as (select distinct scenario, node from picked join taken using (scenario, attempt))
select scenario, round(sum(l.kw) / 1000, 6) as unserved_mw, round(sum(case when is_critical then l.kw else 0 end) / 1000, 6) as critical_mw, round(sum(l.kw * voll), 4) as voll_per_h, count(*) as n_loads, count(distinct l.node) as n_islands from hit join loads l using (node) group by scenario""")
def generated_outages(t: Tables) -> DataFrame:
    """What is dark in each generated scenario, evaluated for all scenarios in one go."""
    from ..operators import graph

    x = graph.outage_metrics(graph.tree_unserved(_sampled(t).select("scenario", "node"), v.loads(t)))
    return x.select("scenario", R("unserved_mw", 6).alias("unserved_mw"), R("critical_mw", 6).alias("critical_mw"), R("voll_per_h", 4).alias("voll_per_h"), "n_loads", "n_islands")
