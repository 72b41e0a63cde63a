"""Further queries: geometry, copies, memberships, tracks, valuations and figure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as s
from ..functions import text
from ..operators import checks, economics, hazard, relational, testbed
from ..operators.scratch import small
from ..sources.files import point_in_ring
from . import assessment as a
from . import views as v
from .catalog import query
from .simulated import uniform_sql
from .views import Tables

R = F.round


@query("P16 U01", """select 'r' || r_regionkey || '_' || s_suppkey as node_id, round(50 + (s_acctbal - (select avg(s_acctbal) from supplier)) * 0.5 + r_regionkey * 10, 6) as x from supplier, region""")
def region_copies(t: Tables) -> DataFrame:
    """Every node once for each region: scaled about the centroid, shifted, and with the region's prefix."""
    centre = t.supplier.agg(F.avg("s_acctbal").alias("c"))
    regions = t.region.select("r_regionkey")
    met = t.supplier.select("s_suppkey", "s_acctbal").crossJoin(F.broadcast(centre)).crossJoin(small(regions))  # one row; and regions if they are few
    name = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit("_"), F.col("s_suppkey").cast("string"))
    return met.select(name.alias("node_id"), R(50 + (F.col("s_acctbal") - F.col("c")) * 0.5 + F.col("r_regionkey") * 10, 6).alias("x"))


@query("P21 F31", """select s_suppkey, case when s_suppkey % 3 > 0 then 'P' || s_nationkey || 'U' end as area, case when s_suppkey % 3 > 0 then 'p' || s_nationkey || 'uhs' || s_suppkey end as root, case when s_suppkey % 3 > 0 then 12.47 end as kv from supplier""")
def substation_ids(t: Tables) -> DataFrame:
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    name = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("P"), nation, F.lit("Uhs"), key, F.lit("_1247"))).otherwise(F.concat(F.lit("feeder"), key))
    p = text.substation_parts(name)
    return t.supplier.select("s_suppkey", p["service_area"].alias("area"), p["root_bus"].alias("root"), p["kv"].alias("kv"))


@query("P24 P01", "select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderstatus = 'F' and o_orderpriority = '2-HIGH' order by o_orderdate, o_orderkey limit 40")
def first_cases(t: Tables) -> DataFrame:
    """The first forty cases of a smoke run: the limit is the feature."""
    x = t.orders.where("o_orderstatus = 'F' and o_orderpriority = '2-HIGH'").select("o_orderkey", "o_custkey", "o_orderdate")
    return x.orderBy("o_orderdate", "o_orderkey").limit(40).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("J04 T06", f"""with {v.EPISODES}, x as (select subset, scenario, min(case when policy = 'greedy' then damage end) as greedy, min(case when policy = 'learned' then damage end) as learned, min(damage) * 0.98 as ga from episodes group by all)
select subset, scenario, round(100 * (greedy - ga) / greedy, 6) as ga_gain_pct, round(100 * (greedy - learned) / greedy, 6) as learned_gain_pct from x where greedy is not null and learned is not null""")
def ga_table(t: Tables) -> DataFrame:
    """One-to-one chain of search, selected policy and greedy."""
    e, case = v.episodes(t), ["subset", "scenario"]
    greedy, learned = (e.where(F.col("policy") == p).select(*case, F.col("damage").alias(p)) for p in ("greedy", "learned"))
    ga = e.groupBy(*case).agg((F.min("damage") * 0.98).alias("ga"))
    met = ga.join(greedy, case).join(learned, case)
    gain = lambda k: R(100 * (F.col("greedy") - F.col(k)) / F.col("greedy"), 6).alias(f"{k}_gain_pct")
    return met.select(*case, gain("ga"), gain("learned"))


@query("J06 X28", f"""with {v.TRAJECTORY}, m as (select distinct scenario, 'all' as subset from damage union all select scenario, 'long' from damage group by scenario having count(*) > 9 union all select distinct scenario, 'late' from damage where scenario >= 199801)
select subset, count(distinct scenario) as scenarios, count(*) as steps, round(sum(step_ens), 3) as ens from trajectory join m using (scenario) group by subset""")
def membership_expansion(t: Tables) -> DataFrame:
    """Each scenario is simulated once and counted in every subset that it belongs to."""
    d = v.damage(t).groupBy("scenario").agg(F.count("*").alias("n"))
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("n") > 9, "long"), F.when(F.col("scenario") >= 199801, "late")))
    member = d.select("scenario", F.explode(subsets).alias("subset"))
    return v.trajectory(t).join(member, "scenario").groupBy("subset").agg(F.count_distinct("scenario").alias("scenarios"), F.count("*").alias("steps"), R(F.sum("step_ens"), 3).alias("ens"))


@query("J22 H04", f"""with {a.POINTS} select point_id, lat > 27.55 and lat < 30.25 and lon > -95.25 and lon < -88.75 as inside from points""")
def points_in_polygon(t: Tables) -> DataFrame:
    corners = ((-95.25, 27.55), (-88.75, 27.55), (-88.75, 30.25), (-95.25, 30.25))
    ring = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in corners))
    return a.points(t).select("point_id", point_in_ring(F.col("lon"), F.col("lat"), ring).alias("inside"))


@query("A01 T04 ST07", f"""with {v.EPISODES} select policy, count(*) as n, round(avg(damage), 4) as damage, round(avg(ens), 6) as ens, max(steps) as most_steps from episodes group by 1""")
def policy_means(t: Tables) -> DataFrame:
    return v.episodes(t).groupBy("policy").agg(F.count("*").alias("n"), R(F.avg("damage"), 4).alias("damage"), R(F.avg("ens"), 6).alias("ens"), F.max("steps").alias("most_steps"))


@query("W04 G07", f"""with {v.LOADS} select node, min_by(load_id, row(kw, load_id)) as root, count(*) as n from loads group by node""")
def roots(t: Tables) -> DataFrame:
    """The least load of each node stands for it, the least id among equals."""
    return v.loads(t).groupBy("node").agg(F.min_by("load_id", F.struct("kw", "load_id")).alias("root"), F.count("*").alias("n"))


@query("O05 A26", """select o_orderpriority as label, count(*) as n, case o_orderpriority when '5-LOW' then 0 when '1-URGENT' then 1 else 2 end as place from orders group by 1""")
def category_order(t: Tables) -> DataFrame:
    order = t.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.lit(i).alias("place")) for i, k in enumerate(("5-LOW", "1-URGENT"))))).alias("x")).select("x.*")
    counted = t.orders.groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(order), "label", "left").select("label", "n", F.coalesce("place", F.lit(2)).alias("place"))


@query("U04 U05", f"""with {v.LOADS}, {v.DAMAGE}, zone as (select s_nationkey as node from supplier group by 1 having count(*) > 4)
select scenario, cast(sum(case when node in (select node from zone) then 1 else 0 end) as bigint) as in_zone, cast(sum(case when node not in (select node from zone) then 1 else 0 end) as bigint) as outside from damage group by scenario""")
def zone_overlap(t: Tables) -> DataFrame:
    zone = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("node")).agg(F.count("*").alias("n")).where("n > 4").agg(F.collect_set("node").alias("zone"))  # nations at most
    dark = v.damage(t).groupBy("scenario").agg(F.collect_set("node").alias("dark"))
    met = dark.crossJoin(F.broadcast(zone))  # one row
    return met.select("scenario", F.size(F.array_intersect("dark", "zone")).cast("long").alias("in_zone"), F.size(F.array_except("dark", "zone")).cast("long").alias("outside"))


@query("F02 F03", f"""with {a.POINTS} select point_id, round(sqrt(pow((-90.0 - lon) * 111.321 * cos(radians((lat + 29.5) / 2)), 2) + pow((29.5 - lat) * 111.0, 2)), 6) as km, round((lat + 29.5) / 2, 6) as mid_lat from points""")
def flat_distances(t: Tables) -> DataFrame:
    km = s.flat_distance_km(F.col("lat"), F.col("lon"), F.lit(29.5), F.lit(-90.0))
    return a.points(t).select("point_id", R(km, 6).alias("km"), R(s.midpoint(F.col("lat"), F.lit(29.5)), 6).alias("mid_lat"))


@query("F04 F26 F29 F32", """select s_suppkey, round(s_acctbal * (322.0 / 251.0), 6) as dollars, (s_suppkey - 30 + 7 + 96 * 100) % 96 as slot, round(greatest(s_acctbal, 0) * 0.02, 6) as area, list_reduce(list_prepend(0, list_transform(string_split(s_name, ''), lambda c: ascii(c))), lambda x, y: x + y) % 360 as angle from supplier""")
def small_functions(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", R(s.rebased(F.col("s_acctbal"), 251.0, 322.0), 6).alias("dollars"), s.wrapped(F.col("s_suppkey") - 30, 7, 96).alias("slot"), R(F.greatest("s_acctbal", F.lit(0.0)) * 0.02, 6).alias("area"), s.letter_angle(F.col("s_name")).alias("angle"))


@query("H02 ST06", """with x as (select l_suppkey as storm, count(*) as n from lineitem group by 1 having count(*) > 2) select storm from (select storm, row_number() over (order by cast('0x' || substr(sha256('11|' || storm), 1, 13) as bigint), storm) as i from x) where i <= 20""")
def storm_sample(t: Tables) -> DataFrame:
    """Twenty storms without replacement: those with the least hashes of a seed and their ids."""
    x = t.lineitem.groupBy(F.col("l_suppkey").alias("storm")).agg(F.count("*").alias("n")).where("n > 2")
    return x.orderBy(hazard.uniform(11, F.col("storm")), "storm").limit(20).select("storm")


@query("H05 H06", f"""with {a.TRACKS}, o as (select *, lat - lag(lat) over w as dlat, lon - lag(lon) over w as dlon, row_number() over (partition by storm order by time_index desc) as place from tracks window w as (partition by storm order by time_index)),
l as (select *, greatest(1e-4, sqrt(pow(dlon * 111.321 * cos(radians((lat - dlat + lat) / 2)), 2) + pow(dlat * 111.0, 2))) as km, least(200, greatest(0, ceil(ln(speed / 20.0) / (0.005 * 15.0)))) as steps from o where place = 1),
m as (select storm, time_index + k as time_index, lat + dlat * k * 15.0 / km as lat, lon + dlon * k * 15.0 / km as lon, speed * exp(-0.005 * k * 15.0) as speed from l, range(1, 201) r(k) where speed > 20 and k <= steps)
select storm, count(*) as n, round(min(speed), 6) as last_speed, round(max(lat), 6) as max_lat, round(max(lon), 6) as max_lon from (select storm, lat, lon, speed from tracks union all select storm, lat, lon, speed from m) group by storm""")
def extended_tracks(t: Tables) -> DataFrame:
    x = hazard.extended_track(a.tracks(t), ["storm"], 0.005)
    return x.groupBy("storm").agg(F.count("*").alias("n"), R(F.min("speed"), 6).alias("last_speed"), R(F.max("lat"), 6).alias("max_lat"), R(F.max("lon"), 6).alias("max_lon"))


@query("H08 J10", f"""with {a.POINTS}, {a.TRACKS}, firsts as (select storm, min_by(speed, time_index) as v0 from tracks group by storm),
ends as (select p.point_id as edge_id, unnest([p.lat, q.lat, (p.lat + q.lat) / 2]) as lat, unnest([p.lon, q.lon, (p.lon + q.lon) / 2]) as lon from points p join points q on q.point_id = p.point_id + 1),
dist as (select p.edge_id, t.storm, t.speed, t.rmax_km, v0, {a.HAVERSINE.format(a="p", b="t")} as km from ends p, tracks t join firsts using (storm)),
wind as (select edge_id, storm, case when km < 1e-9 then speed else speed * pow(rmax_km / km, 1.05 * ln(v0) - 2.32) * exp(1 - pow(rmax_km / km, 1.05 * ln(v0) - 2.32)) end as w from dist)
select storm, edge_id, round(max(w), 6) as wind from wind group by 1, 2""")
def edge_exposure(t: Tables) -> DataFrame:
    """The highest wind at the ends and the middle of each edge."""
    p = a.points(t).select("point_id", "lat", "lon")
    q = p.select((F.col("point_id") - 1).alias("point_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    ends = p.join(q, "point_id").select("point_id", F.explode(F.array(F.struct("lat", "lon"), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")), F.struct(s.midpoint(F.col("lat"), F.col("lat2")).alias("lat"), s.midpoint(F.col("lon"), F.col("lon2")).alias("lon")))).alias("e"))
    x = hazard.max_wind(ends.select("point_id", "e.lat", "e.lon"), a.tracks(t), ["storm"])
    return x.groupBy("storm", F.col("point_id").alias("edge_id")).agg(R(F.max("wind"), 6).alias("wind"))


@query("H15 (seeded draws)", f"""with x as (select s_suppkey, case when s_suppkey % 4 = 1 then 168.0 else 720.0 end as mean, case when s_suppkey % 4 = 1 then 84.0 else 360.0 end as sd, '5|' || s_suppkey as name from supplier)
select s_suppkey, case when s_suppkey % 2 = 0 then 'line' else 'substation' end as kind, case when s_suppkey % 4 = 1 then 'severe' else 'complete' end as state,
  round(case when s_suppkey % 2 = 0 then 3 + 2 * {uniform_sql("name")} else greatest(0, mean + sd * sqrt(-2 * ln({uniform_sql("name || '|radius'")})) * cos(2 * pi() * {uniform_sql("name || '|angle'")})) end, 6) as repair_h from x""")
def repair_times(t: Tables) -> DataFrame:
    x = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "line").otherwise("substation").alias("kind"), F.when(F.col("s_suppkey") % 4 == 1, "severe").otherwise("complete").alias("state"))
    return hazard.repair_hours(x, ["s_suppkey"], 5).withColumn("repair_h", R("repair_h", 6))


@query("Q06 T08", f"""with {v.EPISODES} select subset, scenario, policy, rule from (select subset, scenario, policy, unnest([case when not coalesce(damage < 6000000, false) then 'total is in range' end, case when not coalesce(ens * 1000 between 0 and steps * 30, false) then 'critical is within total' end]) as rule from episodes) where rule is not null""")
def supply_context(t: Tables) -> DataFrame:
    return checks.broken(v.episodes(t), {"total is in range": F.col("damage") < 6_000_000, "critical is within total": (F.col("ens") * 1000).between(0, F.col("steps") * 30)}, ["subset", "scenario", "policy"])


@query("X27 E03 E04 E05", f"""with {v.LOADS}, {v.DAMAGE}, hit as (select scenario, kw, is_critical, load_type, voll, repair_h from damage join loads using (node))
select scenario, round(sum(case when is_critical then kw * 100 else kw * (case when load_type = 'residential' then 10.0 else 25.0 end) end), 6) as marginal_hour, round(sum(kw * repair_h * voll), 6) as old_cost, round(sum(kw * repair_h * case when is_critical then 80.0 when load_type = 'residential' then 4.0 else 18.0 end), 6) as low_cost from hit group by scenario""")
def valuation_cases(t: Tables) -> DataFrame:
    """The cost of one more hour, the older flat value, and a low case, by scenario."""
    hit = v.damage(t).join(v.loads(t), "node")
    hour = economics.load_damage(F.col("kw"), F.col("kw"), F.col("load_type"), F.col("is_critical"))
    low = F.when(F.col("is_critical"), 80.0).when(F.col("load_type") == "residential", 4.0).otherwise(18.0)
    kwh = F.col("kw") * F.col("repair_h")
    return hit.groupBy("scenario").agg(R(F.sum(hour), 6).alias("marginal_hour"), R(F.sum(kwh * F.col("voll")), 6).alias("old_cost"), R(F.sum(kwh * low), 6).alias("low_cost"))


@query("E15 J21", f"""with {a.LEDGER} select subset, interval_years, m, round(greatest(0, (benefit / interval_years - yearly - event_cost / interval_years)) / {a.CRF} * m, 3) as break_even_capital from ledger, (values (1.0), (5.0), (20.0)) i(interval_years), (values (0.5), (1.0)) k(m)""")
def break_even_envelope(t: Tables) -> DataFrame:
    grid = t.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(y).alias("interval_years"), F.lit(m).alias("m")) for y in (1.0, 5.0, 20.0) for m in (0.5, 1.0)))).alias("g")).select("g.*")
    x = a.ledger(t).crossJoin(F.broadcast(grid))  # six cases
    left = F.greatest(F.lit(0.0), (F.col("benefit") - F.col("event_cost")) / F.col("interval_years") - F.col("yearly"))
    return x.select("subset", "interval_years", "m", R(left / s.capital_recovery_factor(F.lit(0.031), 20) * F.col("m"), 3).alias("break_even_capital"))


@query("ST04 J16 A11", f"""with {v.TRAJECTORY}, grid as (select distinct scenario, h as hour from trajectory, range(0, 25, 6) g(h)),
met as (select g.hour, x.unserved_mw / x.initial_mw as share, x.cum_ens - x.step_ens + x.unserved_mw * least(x.duration_h, greatest(0, g.hour - x.start_h)) as ens from grid g join trajectory x using (scenario) where x.start_h <= g.hour and (g.hour < x.end_h or x.end_h = (select max(end_h) from trajectory y where y.scenario = g.scenario)) )
select cast(hour as integer) as hour, round(avg(ens), 4) as mean_ens from met group by hour""")
def common_interruption_curves(t: Tables) -> DataFrame:
    """Mean energy not served on a grid of hours, linear within a repair."""
    x = v.trajectory(t)
    points = x.select("scenario").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(24), F.lit(6))))
    met = relational.as_of(points, x, ["scenario"], "hour", "start_h", ["start_h", "duration_h", "unserved_mw", "cum_ens", "step_ens"])
    ens = F.col("cum_ens") - F.col("step_ens") + F.col("unserved_mw") * F.least("duration_h", F.greatest(F.lit(0.0), F.col("hour") - F.col("start_h")))
    return met.groupBy("hour").agg(R(F.avg(ens), 4).alias("mean_ens"))


@query("ST05", f"""with {v.TRAJECTORY}, onset as (select scenario, initial_mw from trajectory where step_index = 0), listed as (select scenario, sum(kw) / 1000 as mw from damage join node_power using (node) group by 1)
select scenario, round(initial_mw, 6) as onset_mw, abs(initial_mw - mw) <= 1e-6 as aligned from onset join listed using (scenario)""")
def onset_severity(t: Tables) -> DataFrame:
    onset = v.trajectory(t).where("step_index = 0").select("scenario", "initial_mw")
    listed = v.damage(t).join(v.node_power(t), "node").groupBy("scenario").agg((F.sum("kw") / 1000).alias("mw"))
    return onset.join(listed, "scenario").select("scenario", R("initial_mw", 6).alias("onset_mw"), (F.abs(F.col("initial_mw") - F.col("mw")) <= 1e-6).alias("aligned"))


@query("M04 M06 P20", """select n_name as state, cast(count(*) as bigint) as customers, round(sum(c_acctbal) / 1e6, 6) as millions, row_number() over (order by count(*) desc, n_name) as place from customer join nation on c_nationkey = n_nationkey group by n_name""")
def map_table(t: Tables) -> DataFrame:
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("state")).agg(F.count("*").alias("customers"), R(F.sum("c_acctbal") / 1e6, 6).alias("millions"))
    return x.withColumn("place", F.row_number().over(W.orderBy(F.desc("customers"), "state")).cast("long"))  # a row for each state


@query("B07 J23", """with d as (select r_regionkey as region, s_suppkey as node, abs(s_acctbal - r_regionkey * 2000) as km from supplier, region), k as (select region, node from (select *, row_number() over (partition by region order by km, node) as i from d) where i <= 8),
n as (select distinct node from k), e as (select l_suppkey as a, l_partkey % 100 as b from lineitem)
select cast((a in (select node from n))::int + (b in (select node from n))::int as bigint) as ends, count(*) as edges from e group by 1 having ends > 0""")
def subnetwork_extract(t: Tables) -> DataFrame:
    """The nearest eight nodes of each region, their edges, and the edges that cross their border."""
    centres = t.region.select("r_regionkey", (F.col("r_regionkey") * 2000).alias("centre"))
    near = testbed.nearest_peers(t.supplier.select("s_suppkey", "s_acctbal"), centres, "r_regionkey", F.abs(F.col("s_acctbal") - F.col("centre")), "s_suppkey", 8)
    edges = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"))
    inner, border = testbed.extract(edges, near.select(F.col("s_suppkey").alias("node")).distinct())
    both = inner.select(F.lit(2).cast("long").alias("ends")).unionByName(border.select(F.lit(1).cast("long").alias("ends")))
    return both.groupBy("ends").agg(F.count("*").alias("edges"))


def _profiles(t: Tables) -> DataFrame:
    hour = F.hour(F.col("ts").cast("timestamp"))
    return t.events.groupBy(F.col("event_type").alias("profile_id"), hour.alias("t")).agg((F.count("*") / 100.0).alias("multiplier"))


def _profiled(t: Tables) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("click", "error", "view")))
    return v.loads(t).select("load_id", F.element_at(kinds, (F.col("load_id") % 3 + 1).cast("int")).alias("profile_id"), "kw", "node")


@query("B10 A33 S08", f"""with {v.LOADS}, p as (select event_type as profile_id, hour(ts) as t, count(*) / 100.0 as m from events group by 1, 2), l as (select ['click', 'error', 'view'][load_id % 3 + 1] as profile_id, sum(kw) as kw from loads group by 1)
select cast(t as integer) as t, round(sum(kw * m), 6) as kw from l join p using (profile_id) group by t""")
def load_timeseries(t: Tables) -> DataFrame:
    series = testbed.load_series(_profiled(t), _profiles(t))
    return series.groupBy("t").agg(R(F.sum("kw"), 6).alias("kw"))


@query("B10 (series and profiles conserve power)", f"""with {v.LOADS}, p as (select event_type as profile_id, hour(ts) as t, count(*) / 100.0 as m from events group by 1, 2), l as (select ['click', 'error', 'view'][load_id % 3 + 1] as profile_id, sum(kw) as kw from loads group by 1)
select cast(t as integer) as t, round(sum(kw * m), 6) as want, 0.0::double as residual from l join p using (profile_id) group by t""")
def load_conservation(t: Tables) -> DataFrame:
    x = testbed.conservation(testbed.load_series(_profiled(t), _profiles(t)), _profiled(t), _profiles(t))
    return x.select("t", R("want", 6).alias("want"), R(F.abs(F.col("kw") - F.col("want")) / F.col("want"), 6).alias("residual"))


@query("B11 G10 T09", """select 'case isn''t connected' as rule, (select count(distinct r_regionkey) from region) - 1 as n union all select 'power isn''t positive', count(*) from customer where not (c_acctbal > 0) having count(*) > 0""")
def smoke_checks(t: Tables) -> DataFrame:
    """Nations connected within their regions only, loads as they are in the table."""
    n = t.nation.select("n_regionkey", F.col("n_nationkey").alias("n"))
    edges = n.withColumnRenamed("n", "a").join(n.groupBy("n_regionkey").agg(F.min("n").alias("b")), "n_regionkey")
    loads = t.customer.select(F.col("c_custkey").alias("load_id"), F.col("c_nationkey").alias("node"), F.col("c_acctbal").alias("kw"))
    return testbed.smoke_faults(t.nation.select(F.col("n_nationkey").alias("node")), edges, loads)
