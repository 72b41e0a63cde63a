"""Queries on hazard, adequacy, economics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import economics, hazard, relational, resampling, spatial, stats, supply
from ..operators.scratch import small
from . import views as v
from .catalog import query
from .views import Tables

R = F.round

# places: suppliers are points, orders of a month are a storm's track
POINTS = "points as (select s_suppkey as point_id, 27.0 + (s_suppkey % 40) / 10.0 as lat, -96.0 + s_nationkey / 2.0 as lon, s_acctbal from supplier)"
TRACKS = """tracks as (select cast(n_regionkey as bigint) as storm, cast(n_nationkey as bigint) as time_index, 25.0 + n_nationkey / 4.0 as lat, -97.0 + n_nationkey / 3.0 as lon, 30.0 + 4 * (n_nationkey % 7) as speed,
  46.3 * exp(-0.0153 * (60.0 + 5 * (n_nationkey % 7))) as rmax_km from nation)"""
HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"


def points(t: Tables) -> DataFrame:
    lat = 27.0 + (F.col("s_suppkey") % 40) / 10.0
    return t.supplier.select(F.col("s_suppkey").alias("point_id"), lat.alias("lat"), (-96.0 + F.col("s_nationkey") / 2.0).alias("lon"), "s_acctbal")


def tracks(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.nation.select(
        F.col("n_regionkey").cast("long").alias("storm"), n.cast("long").alias("time_index"), (25.0 + n / 4.0).alias("lat"), (-97.0 + n / 3.0).alias("lon"), (30.0 + 4 * (n % 7)).alias("speed"), s.rmax_km(60.0 + 5 * (n % 7)).alias("rmax_km")
    )


@query("F15 F16 J20 A31 H07", f"""with {POINTS}, {TRACKS}, firsts as (select storm, min_by(speed, time_index) as v0 from tracks group by storm),
dist as (select p.point_id, t.storm, t.time_index, t.speed, t.rmax_km, v0, {HAVERSINE.format(a="p", b="t")} as km from points p, tracks t join firsts using (storm)),
wind as (select *, case when km < 1e-9 then speed else speed * pow(rmax_km / km, 1.05 * ln(v0) - 2.32) * exp(1 - pow(rmax_km / km, 1.05 * ln(v0) - 2.32)) end as w from dist)
select storm, point_id, round(max(w), 6) as wind from wind group by storm, point_id""")
def holland_max_wind(t: Tables) -> DataFrame:
    return hazard.max_wind(points(t).select("point_id", "lat", "lon"), tracks(t), ["storm"]).select("storm", "point_id", R("wind", 6).alias("wind"))


@query("F01 J23 G09", f"""with {POINTS}, {TRACKS} select point_id, round(min({HAVERSINE.format(a="p", b="t")}), 6) as nearest_km from points p, tracks t group by point_id""")
def haversine_nearest(t: Tables) -> DataFrame:
    """Each point's distance to the nearest place of a reference set, by a quadtree."""
    x = spatial.neighbours(points(t).withColumnRenamed("point_id", "query"), tracks(t).withColumnRenamed("time_index", "id"))
    return x.select(F.col("query").alias("point_id"), R("km", 6).alias("nearest_km"))


@query("J19 F01 P13", f"""with {POINTS}, {TRACKS} select t.time_index as site, count(*) as n, round(sum(greatest(p.s_acctbal, 0)), 3) as near_load
from tracks t join points p on p.lat between t.lat - 1 and t.lat + 1 and {HAVERSINE.format(a="t", b="p")} <= 80 group by 1""")
def radius_load_sums(t: Tables) -> DataFrame:
    """Sums within 80 km of each site. Sites and points meet on a grid of one degree and its neighbours only."""
    sites = tracks(t).select("time_index", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    around = lambda c: F.explode(F.sequence(F.floor(c) - 1, F.floor(c) + 1))
    sites = sites.withColumn("gy", around(F.col("lat2"))).withColumn("gx", around(F.col("lon2")))
    near = points(t).withColumns({"gy": F.floor("lat"), "gx": F.floor("lon")}).join(sites, ["gy", "gx"])
    inside = near.where(s.haversine_km(F.col("lat2"), F.col("lon2"), F.col("lat"), F.col("lon")) <= 80)
    return inside.groupBy(F.col("time_index").alias("site")).agg(F.count("*").alias("n"), R(F.sum(F.greatest("s_acctbal", F.lit(0.0))), 3).alias("near_load"))


PHI = "(case when {x} >= 0 then 1 - 0.3989422804014327 * exp(-{x} * {x} / 2) * {t} else 0.3989422804014327 * exp(-{x} * {x} / 2) * {t} end)"


def _phi(x: str) -> str:
    k = f"(1 / (1 + 0.2316419 * abs({x})))"
    return PHI.format(x=x, t=f"({k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429)))))")


@query("H09 F11 H13", f"""with speeds as (select distinct p_size * 4 + 80 as mph from part), z as (select mph, (ln(mph) - 5.068) / 0.136 as a, (ln(mph) - 5.204) / 0.147 as b, (ln(mph) - 5.523) / 0.132 as c from speeds)
select cast(mph as integer) as mph, round(1 - {_phi("a")}, 6) as p_none, round(greatest(0, {_phi("a")} - {_phi("b")}), 6) as p_moderate, round(greatest(0, {_phi("b")} - {_phi("c")}), 6) as p_severe, round({_phi("c")}, 6) as p_complete from z""")
def substation_states(t: Tables) -> DataFrame:
    speeds = t.part.select((F.col("p_size") * 4 + 80).alias("mph")).distinct()
    return speeds.select("mph", *(R(p, 6).alias(k) for k, p in hazard.substation_states(F.col("mph").cast("double")).items()))


def _by_yaw(values: tuple) -> str:
    out = f"case when x <= 0 then {values[0]}"
    for i in range(4):
        out += f" when x <= {10 * (i + 1)} then {values[i]} + (x - {10 * i}) * ({values[i + 1]} - {values[i]}) / 10.0"
    return out + f" else {values[4]} end"


@query("H10 F12 F14", f"""with p as (select distinct p_size from part), w as (select p_size, p_size + 30.0 as v, least(40.0, abs(degrees(atan2(p_size - 20.0, -(p_size % 7 - 3.5))) - degrees(atan2(1.0, p_size % 5 + 0.5))) % 90) as x from p),
k as (select *, v >= {_by_yaw((68.0, 69.0, 72.0, 77.0, 0.0))} as high, {_by_yaw((4.251, 4.266, 4.313, 4.398, 4.544))} as m1, {_by_yaw((0.0245, 0.0244, 0.0245, 0.0283, 0.0385))} as s1, {_by_yaw((4.267, 4.282, 4.330, 4.414, 4.544))} as m2, {_by_yaw((0.0363, 0.0362, 0.0365, 0.0369, 0.0385))} as s2 from w),
z as (select p_size, (ln(v) - case when high then m1 else m2 end) / case when high then s1 else s2 end as z from k)
select p_size, round(greatest(0, least(1, {_phi("z")})), 6) as p_fail from z""")
def conductor_fragility(t: Tables) -> DataFrame:
    k = F.col("p_size")
    attack = s.attack_angle(k - 20.0, k % 7 - 3.5, k % 5 + 0.5, F.lit(1.0))
    return t.part.select("p_size").distinct().select("p_size", R(hazard.conductor_failure(k + 30.0, attack), 6).alias("p_fail"))


#: The regressions for poles of class 5, 50 years old and 12 m high, written out.
POLE_MEAN_SQL = """6.597 - 0.01285 * x - 0.08189 * c + 0.00685 * 50 - 0.0654 * 12 + 0.00004979 * x * x - 0.001368 * c * x + 0.005333 * c * c - 0.0000007649 * x * 50 - 0.000003429 * c * 50
  - 0.0001405 * 2500 + 0.0002438 * x * 12 + 0.001743 * c * 12 - 0.00001836 * 600 + 0.0005301 * 144"""
POLE_SPREAD_SQL = """0.1497 + 0.0002763 * x + 0.002362 * c - 0.002293 * 50 + 0.00006042 * 12 - 0.0000005062 * x * x + 0.000001237 * c * x - 0.00007755 * c * c - 0.000002332 * x * 50 - 0.00002446 * c * 50
  + 0.00006829 * 2500 - 0.000004114 * x * 12 - 0.00002209 * c * 12 + 0.00001401 * 600 - 0.0000002003 * 144"""


@query("H11 H12 F13", f"""with p as (select distinct p_size from part), w as (select p_size, p_size + 20.0 as v, (p_size * 7 % 90)::double as x, 3 * 0.011 * greatest(30.0, least(120.0, p_size * 3.0)) as c from p),
z as (select p_size, (ln(v * 2.23694) - ({POLE_MEAN_SQL})) / greatest(1e-6, {POLE_SPREAD_SQL}) as z from w)
select p_size, round(greatest(0, least(1, {_phi("z")})), 6) as p_fail from z""")
def pole_fragility(t: Tables) -> DataFrame:
    k = F.col("p_size")
    return t.part.select("p_size").distinct().select("p_size", R(hazard.pole_failure(k + 20.0, (k * 7 % 90).cast("double"), k * 3.0), 6).alias("p_fail"))


@query("E13 E14", """with items as (select p_brand as cost_case, p_size * 1000.0 as cost from part), sums as (select cost_case, sum(cost) as direct from items group by 1)
select cost_case, estimate_class, round(direct * (1.04 + 0.1) * (1 + 0.15 + 0.08) * (322.0 / 292.0) * m, 4) as capital, round(direct * (1.04 + 0.1) * (1 + 0.15 + 0.08) * (322.0 / 292.0) * m / 15000, 6) as per_export_kw from sums, (values ('low', 0.7), ('point', 1.0), ('high', 1.5)) c(estimate_class, m)""")
def capital_cases(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_brand").alias("cost_case"), (F.col("p_size") * 1000.0).alias("cost"))
    x = economics.capital_cases(items, {"low": 0.7, "point": 1.0, "high": 1.5}, 1.04, 0.1, 0.15, 0.08, 322.0 / 292.0)
    return x.select("cost_case", "estimate_class", R("capital", 4).alias("capital"), R(F.col("capital") / 15000, 6).alias("per_export_kw"))


@query("P04 W01 A19 H01", """with x as (select l_suppkey as storm, l_shipdate as at, l_quantity * 3 as kts, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as time_index from lineitem)
select storm, count(*) as n_points, max(kts) as max_kts, min_by(kts, time_index) as first_kts,
  case when max(kts) >= 137 then 'category_5' when max(kts) >= 113 then 'category_4' when max(kts) >= 96 then 'category_3' when max(kts) >= 83 then 'category_2' when max(kts) >= 64 then 'category_1' when max(kts) >= 34 then 'tropical_storm' else 'tropical_depression' end as category from x group by storm""")
def storm_summary(t: Tables) -> DataFrame:
    x = t.lineitem.select(F.col("l_suppkey").alias("storm"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_quantity") * 3).alias("wind_kts"))
    x = hazard.indexed_track(x, ["storm"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    out = x.groupBy("storm").agg(F.count("*").alias("n_points"), F.max("wind_kts").alias("max_kts"), F.min_by("wind_kts", "time_index").alias("first_kts"))
    return out.withColumn("category", s.category(F.col("max_kts")))


@query("H14 H17 (seeded draws by hash)", """select cast(s_nationkey as bigint) as node, trial, count(*) as n_damaged from (
  select s_nationkey, s_suppkey, trial, (cast('0x' || substr(sha256('7|' || s_suppkey || '|' || trial), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u, least(0.9, s_suppkey % 10 / 10.0) as p
  from supplier, range(1, 21) r(trial)) where u < p group by 1, 2""")
def damage_mc(t: Tables) -> DataFrame:
    p = t.supplier.select(F.col("s_nationkey").cast("long").alias("node"), "s_suppkey", F.least(F.lit(0.9), F.col("s_suppkey") % 10 / 10.0).alias("p"))
    hit = hazard.realised(p, ["s_suppkey"], 20, 7).where("damaged")
    return hit.groupBy("node", F.col("trial").cast("long").alias("trial")).agg(F.count("*").alias("n_damaged"))


FLEET = "fleet as (select cast(p_size as bigint) as capacity_mw, 0.02 + p_size % 5 / 50.0 as q, p_partkey as unit, p_partkey // 10 as fleet from part)"


def fleet(t: Tables) -> DataFrame:
    """Fleets of ten units of whole MW."""
    return t.part.select(F.floor(F.col("p_partkey") / 10).alias("fleet"), F.col("p_size").cast("long").alias("capacity_mw"), (0.02 + F.col("p_size") % 5 / 50.0).alias("q"), F.col("p_partkey").alias("unit"))


def demands_of(t: Tables) -> DataFrame:
    """Each fleet with each of the demands; these are as many as there are sizes."""
    demands = t.part.select((F.col("p_size") * 6).cast("double").alias("demand")).distinct()
    return fleet(t).select("fleet").distinct().crossJoin(small(demands))


COPT = f"""{FLEET}, placed as (select *, row_number() over (partition by fleet order by unit) as i from fleet), units as (select fleet, count(*) as n from fleet group by fleet),
steps(fleet, i, cap, p) as (select fleet, cast(0 as bigint), cast(0 as bigint), cast(1 as double) from units union all
  select s.fleet, s.i + 1, s.cap + case when b.up then f.capacity_mw else 0 end, s.p * case when b.up then 1 - f.q else f.q end from steps s join placed f on f.fleet = s.fleet and f.i = s.i + 1, (values (true), (false)) b(up)),
copt as (select steps.fleet, cap as capacity_mw, sum(p) as p from steps join units on units.fleet = steps.fleet where i = n group by all)"""


@query("Q01 Q02 Q03 W08", f"""with recursive {COPT}, demand as (select fleet, demand from (select distinct cast(p_size * 6 as double) as demand from part), units)
select d.fleet, demand, round(coalesce(sum(p * (demand - capacity_mw)), 0), 6) as expected_shortage, round(coalesce(sum(p), 0), 6) as p_shortage from demand d left join copt on copt.fleet = d.fleet and capacity_mw < demand group by all""")
def shortage_expectation(t: Tables) -> DataFrame:
    table = supply.capacity_table(fleet(t), ["fleet"])
    demands = demands_of(t)
    x = supply.shortage(table, demands, ["fleet"])
    return x.select("fleet", "demand", R("expected_shortage", 6).alias("expected_shortage"), R("p_shortage", 6).alias("p_shortage"))


@query("Q02", f"with recursive {COPT} select fleet, capacity_mw, round(p, 9) as p from copt where p > 0")
def copt(t: Tables) -> DataFrame:
    table = supply.capacity_table(fleet(t), ["fleet"])
    return table.select("fleet", "capacity_mw", R("p", 9).alias("p"))


def _allocation_sql() -> str:
    base = "select load_id, greatest(0, k - c) as critical_loss, greatest(0, c - k) as rest, t - k as ordinary, dc from x"
    rules = {
        "conventional": "critical_loss + greatest(0, ordinary + dc - rest) * (case when ordinary + dc > 0 then ordinary / (ordinary + dc) else 0 end) as loss, greatest(0, ordinary + dc - rest) * (1 - case when ordinary + dc > 0 then ordinary / (ordinary + dc) else 0 end) as dc_loss",
        "dc_first": "critical_loss + greatest(0, ordinary + dc - rest) - least(dc, greatest(0, ordinary + dc - rest)) as loss, least(dc, greatest(0, ordinary + dc - rest)) as dc_loss",
        "dc_priority_upper": "critical_loss + least(ordinary, greatest(0, ordinary + dc - rest)) as loss, greatest(0, ordinary + dc - rest) - least(ordinary, greatest(0, ordinary + dc - rest)) as dc_loss",
    }
    each = " union all ".join(f"select load_id, '{k}' as rule, round(loss, 6) as loss, round(critical_loss, 6) as critical_loss, round(dc_loss, 6) as dc_loss from (select load_id, critical_loss, {e} from b)" for k, e in rules.items())
    return f"with {v.LOADS}, x as (select load_id, kw as t, kw * 0.3 as k, kw * (load_id % 13) / 10.0 as c, cast(load_id % 4 as double) * 50 as dc from loads), b as ({base}) {each}"


@query("Q04", _allocation_sql())
def supply_allocation_modes(t: Tables) -> DataFrame:
    x = v.loads(t).select("load_id", F.col("kw").alias("t"), (F.col("kw") * 0.3).alias("k"), (F.col("kw") * (F.col("load_id") % 13) / 10.0).alias("c"), (F.col("load_id") % 4).cast("double").alias("m"))
    rows = []
    for rule in ("conventional", "dc_first", "dc_priority_upper"):
        loss, critical, dc = supply.allocate(F.col("c"), F.col("t"), F.col("k"), F.col("m") * 50, rule)
        rows.append(F.struct(F.lit(rule).alias("rule"), R(loss, 6).alias("loss"), R(critical, 6).alias("critical_loss"), R(dc, 6).alias("dc_loss")))
    return x.select("load_id", F.explode(F.array(*rows)).alias("r")).select("load_id", "r.*")


@query("Q05 F18", f"""with recursive {COPT}, grid as (select distinct cast(p_size * 6 as double) as demand from part), added as (select * from (values (0, 0.01), (1, 0.18), (2, 0.81)) a(up, w))
select fleet, demand, round(sum(case when capacity_mw + 30 * up < demand then w * p * (demand - capacity_mw - 30 * up) else 0 end), 6) as expected_shortage, round(sum(case when capacity_mw + 30 * up < demand then w * p else 0 end), 6) as p_shortage
from grid, copt, added group by all""")
def adequacy_table(t: Tables) -> DataFrame:
    """Two added units of 30 MW that are up nine times in ten: a binomial mixture over the shifted table."""
    table = supply.capacity_table(fleet(t), ["fleet"])
    states = F.array(*(F.struct(F.lit(30 * k).alias("more"), w.alias("w")) for k, w in enumerate(s.binomial_weights(2, F.lit(0.9)))))
    mixed = table.withColumn("a", F.explode(states)).groupBy("fleet", (F.col("capacity_mw") + F.col("a.more")).alias("capacity_mw")).agg(F.sum(F.col("p") * F.col("a.w")).alias("p"))
    demands = demands_of(t)
    x = supply.shortage(mixed, demands, ["fleet"])
    return x.select("fleet", "demand", R("expected_shortage", 6).alias("expected_shortage"), R("p_shortage", 6).alias("p_shortage"))


PAIRS = f"""{v.EPISODES}, pairs as (select a.subset, a.scenario, a.damage, a.ens, b.damage as damage_base, b.ens as ens_base from episodes a join episodes b on a.subset = b.subset and a.scenario = b.scenario and a.policy = 'learned' and b.policy = 'greedy')"""


def pairs(t: Tables) -> DataFrame:
    e = v.episodes(t)
    return relational.paired(e.where("policy = 'learned'"), e.where("policy = 'greedy'"), ["subset", "scenario"], ["damage", "ens"])


@query("J02 J08 A04 ST02", f"""with {PAIRS} select subset, count(*) as n, round(avg(damage_base - damage), 4) as mean_reduction, round(median(damage_base - damage), 4) as median_reduction,
  round(avg(case when damage_base - damage > 1e-6 then 1.0 else 0 end), 6) as win_rate, round(avg(case when abs(damage_base - damage) <= 1e-6 then 1.0 else 0 end), 6) as tie_rate, round(avg(case when damage_base - damage < -1e-6 then 1.0 else 0 end), 6) as loss_rate
from pairs group by subset""")
def pairwise_vs_baseline(t: Tables) -> DataFrame:
    x = stats.comparison(pairs(t), ["subset"], "damage", "damage_base")
    return x.select("subset", "n", *(R(k, 4).alias(k) for k in ("mean_reduction", "median_reduction")), *(R(k, 6).alias(k) for k in ("win_rate", "tie_rate", "loss_rate")))


@query("A06 A07 J07", f"""with {PAIRS} select subset, round(100 * (avg(damage_base) - avg(damage)) / nullif(avg(damage_base), 0), 6) as ratio_of_means_pct, round(100 * avg((damage_base - damage) / nullif(damage_base, 0)), 6) as mean_of_ratios_pct from pairs group by subset""")
def ratio_of_means_vs_mean_of_ratios(t: Tables) -> DataFrame:
    x = stats.reductions(pairs(t), ["subset"], "damage", "damage_base")
    return x.select("subset", R("ratio_of_means_pct", 6).alias("ratio_of_means_pct"), R("mean_of_ratios_pct", 6).alias("mean_of_ratios_pct"))


@query("A02 A03 A05 T05", f"""with {v.EPISODES}, one as (select subset, policy, count(distinct scenario) as n, avg(damage) as d, avg(ens) as e, avg(case when steps > 100 then 1.0 else 0 end) as r from episodes group by 1, 2)
select policy, cast(sum(n) as bigint) as n, round(avg(d), 4) as damage, round(avg(e), 6) as ens, round(avg(r), 6) as long_rate from one group by policy""")
def mean_of_subset_means(t: Tables) -> DataFrame:
    one = v.episodes(t).groupBy("subset", "policy").agg(F.count_distinct("scenario").alias("n"), F.avg("damage").alias("d"), F.avg("ens").alias("e"), F.avg((F.col("steps") > 100).cast("double")).alias("r"))
    return one.groupBy("policy").agg(F.sum("n").alias("n"), R(F.avg("d"), 4).alias("damage"), R(F.avg("e"), 6).alias("ens"), R(F.avg("r"), 6).alias("long_rate"))


@query("F17 ST02", f"""with {PAIRS}, c as (select subset, cast(sum(case when damage < damage_base then 1 else 0 end) as double) as k, cast(count(*) as double) as n from pairs group by subset), x as (select *, k / n as p, 1 + 1.96 * 1.96 / n as b from c)
select subset, round(100 * ((p + 1.96 * 1.96 / (2 * n)) / b - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / b), 6) as low, round(100 * ((p + 1.96 * 1.96 / (2 * n)) / b + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / b), 6) as high from x""")
def wilson_win_rate(t: Tables) -> DataFrame:
    c = pairs(t).groupBy("subset").agg(F.sum((F.col("damage") < F.col("damage_base")).cast("double")).alias("k"), F.count("*").cast("double").alias("n"))
    low, high = s.wilson(F.col("k"), F.col("n"))
    return c.select("subset", R(low, 6).alias("low"), R(high, 6).alias("high"))


@query("A11 M05", f"""with {v.EPISODES} select subset, policy, count(*) as n, round(avg(ens), 6) as mean, round(greatest(0, avg(ens) - 1.96 * stddev_samp(ens) / sqrt(count(*))), 6) as low, round(least(1, avg(ens) + 1.96 * stddev_samp(ens) / sqrt(count(*))), 6) as high from episodes group by 1, 2""")
def normal_ci(t: Tables) -> DataFrame:
    x = stats.normal_interval(v.episodes(t), ["subset", "policy"], "ens", fraction=True)
    return x.select("subset", "policy", "n", *(R(k, 6).alias(k) for k in ("mean", "low", "high")))


@query("W14", f"""with {v.EPISODES} select subset, policy, scenario, round(row_number() over (partition by subset, policy order by damage, scenario) / count(*) over (partition by subset, policy), 6) as ecdf from episodes""")
def ecdf(t: Tables) -> DataFrame:
    x = relational.ecdf(v.episodes(t), ["subset", "policy"], "damage", ["scenario"])
    return x.select("subset", "policy", "scenario", R("ecdf", 6).alias("ecdf"))


_TIMES = " + ".join(f"(u > {x!r})::int" for x in stats.poisson_steps())


@query("ST01", f"""with {v.EPISODES}, draws as (select subset, policy, draw, damage, (cast('0x' || substr(sha256('11|' || subset || '|' || scenario || '|' || policy || '|' || draw), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u from episodes, range(1, 201) d(draw)),
means as (select subset, policy, draw, sum(damage * ({_TIMES})) / nullif(sum({_TIMES}), 0) as m from draws group by all)
select subset, policy, round(quantile_cont(m, 0.025), 3) as low, round(quantile_cont(m, 0.975), 3) as high from means group by all""")
def bootstrap_ci(t: Tables) -> DataFrame:
    """Percentile intervals of means, each row counted a Poisson number of times in each of 200 draws."""
    key = F.concat_ws("|", "subset", F.col("scenario").cast("string"), "policy")
    x = stats.poisson_bootstrap(v.episodes(t), ["subset", "policy"], "damage", key, 200, 11)
    return x.select("subset", "policy", R("low", 3).alias("low"), R("high", 3).alias("high"))


@query("ST01 (draws of fixed size)")
def bootstrap_fixed(t: Tables) -> DataFrame:
    """The same intervals from draws of exactly as many episodes as there are, with replacement."""
    x = resampling.interval(v.episodes(t), ["subset", "policy"], "damage", ["scenario"], 200, 11)
    return x.select("subset", "policy", R("low", 3).alias("low"), R("high", 3).alias("high"))


@query("F05 F06", """select duration, round(v * case when duration <= 24 then duration else 24 * (case when duration <= 336 then exp((ln(duration) - ln(24.0)) * ln(8.0) / (ln(336.0) - ln(24.0)))
    else exp(ln(8.0) + (ln(duration) - ln(336.0)) * (ln(15.0) - ln(8.0)) / (ln(720.0) - ln(336.0))) end) end, 5) as per_kw
from (select distinct cast(p_size as double) * 20 as duration, 25.0 as v from part)""")
def duration_damage(t: Tables) -> DataFrame:
    d = t.part.select((F.col("p_size").cast("double") * 20).alias("duration")).distinct()
    cost = s.interrupted_kw_cost(F.col("duration"), 25.0, economics.KNOTS, economics.SHAPES["commercial"])
    return d.select("duration", R(cost, 5).alias("per_kw"))


@query("F07 F08 F09 E07 E08", """with x as (select distinct p_size % 20 + 1 as years, p_size / 500.0 as rate from part)
select cast(years as integer) as years, round(rate, 6) as rate, round(rate * pow(1 + rate, years) / (pow(1 + rate, years) - 1), 9) as crf, round((1 - pow(1 + rate, -20.0)) / rate, 8) as annuity, round((1000.0 / 3 - 100) * ((1 - pow(1 + rate, -20.0)) / rate), 6) as ceiling from x""")
def crf_annuity(t: Tables) -> DataFrame:
    x = t.part.select((F.col("p_size") % 20 + 1).alias("years"), (F.col("p_size") / 500.0).alias("rate")).distinct()
    annuity = s.annuity_factor(F.col("rate"), 20)
    ceiling = s.investment_ceiling(F.lit(1200.0), F.lit(200.0), F.lit(3.0), F.lit(100.0), annuity)
    return x.select("years", R("rate", 6).alias("rate"), R(s.capital_recovery_factor(F.col("rate"), F.col("years")), 9).alias("crf"), R(annuity, 8).alias("annuity"), R(ceiling, 6).alias("ceiling"))


LEDGER = f"""{PAIRS}, ledger as (select subset, avg(damage_base) * 1.5 - avg(damage) as benefit, avg(ens) * 1000 as event_cost, 20000.0 as capital, 300.0 as yearly from pairs group by subset)"""
CRF = "(0.031 * pow(1.031, 20) / (pow(1.031, 20) - 1))"


def ledger(t: Tables) -> DataFrame:
    x = pairs(t).groupBy("subset").agg((F.avg("damage_base") * 1.5 - F.avg("damage")).alias("benefit"), (F.avg("ens") * 1000).alias("event_cost"))
    return x.withColumns({"capital": F.lit(20000.0), "yearly": F.lit(300.0)})


@query("E09 E10 F10 J21", f"""with {LEDGER} select subset, interval_years, round(benefit / interval_years, 4) as annual_benefit, round(capital * {CRF} + yearly + event_cost / interval_years, 4) as annual_cost,
  round((benefit / interval_years) / (capital * {CRF} + yearly + event_cost / interval_years), 6) as bcr from ledger, (values (1.0), (2.0), (5.0), (10.0), (20.0), (50.0)) i(interval_years)""")
def bcr_grid(t: Tables) -> DataFrame:
    years = t.spark.range(1).select(F.explode(F.array(*(F.lit(float(y)) for y in (1, 2, 5, 10, 20, 50)))).alias("interval_years"))
    g = economics.benefit_cost_grid(ledger(t), years, 0.031, 20)
    return g.select("subset", "interval_years", R("annual_benefit", 4).alias("annual_benefit"), R("annual_cost", 4).alias("annual_cost"), R("bcr", 6).alias("bcr"))


@query("E11", f"""with {LEDGER} select subset, share, round((benefit / 5 + 50) / (share * (capital * {CRF} + yearly) + 10 + 20 + 3 + event_cost / 5), 6) as host_ratio from ledger, (values (0.0), (0.25), (0.5), (1.0)) s(share)""")
def host_ratio(t: Tables) -> DataFrame:
    shares = t.spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)))).alias("share"))
    g = ledger(t).withColumns({"interval_years": F.lit(5.0), "capital_annual": F.col("capital") * s.capital_recovery_factor(F.lit(0.031), 20), "event_health": F.col("event_cost")})
    return economics.host_ratio(g, shares, 50.0, 10.0, 20.0, 3.0).select("subset", "share", R("host_ratio", 6).alias("host_ratio"))


@query("E12", f"""with {PAIRS}, l as (select subset, avg(damage_base) as dw, avg(damage) as dc, avg(ens) * 1000 as ev from pairs group by subset)
select subset, round(-dw / 10, 4) as storm_without, round(500.0 - 400 - dc / 10 - ev / 10, 4) as storm_with, round(500.0 - 400 - dc / 10 - ev / 10 + dw / 10, 4) as incremental, round((500.0 + dw / 10 - dc / 10) / (400 + ev / 10), 6) as incremental_bcr from l""")
def four_case(t: Tables) -> DataFrame:
    l = pairs(t).groupBy("subset").agg(F.avg("damage_base").alias("damage_without"), F.avg("damage").alias("damage_with"), (F.avg("ens") * 1000).alias("event_cost"))
    x = economics.four_case(l.withColumns({"fiscal": F.lit(500.0), "yearly_cost": F.lit(400.0), "interval_years": F.lit(10.0)}))
    return x.select("subset", *(R(k, 4).alias(k) for k in ("storm_without", "storm_with", "incremental")), R("incremental_bcr", 6).alias("incremental_bcr"))


@query("E16 E17", """with base as (select distinct p_size as a from part), path as (select a, t, 2024 + t as y from base, range(1, 21) r(t)),
val as (select a, t, case when y <= 2030 then a * (y - 2025) / 5.0 when y <= 2040 then a + (2.0 - a) * (y - 2030) / 10.0 else 2.0 end as x from path)
select cast(a as integer) as at_2030, round(sum(x / pow(1.031, t)), 6) as present_value from val group by a""")
def rate_path_pv(t: Tables) -> DataFrame:
    base = t.part.select("p_size").distinct()
    path = economics.rate_path(2025, 20, F.col("p_size").cast("double"), F.lit(2.0))
    return base.select(F.col("p_size").alias("at_2030"), R(economics.present_value(path, 0.031), 6).alias("present_value"))
