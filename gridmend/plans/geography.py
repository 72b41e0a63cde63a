"""Queries over places: nearest ones, polygons that overlap, tracks, and small samples of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import samples, spatial, testbed
from . import assessment as a
from . import tables
from . import views as v
from .catalog import QUERIES, query
from .simulated import uniform_sql
from .views import Tables

R = F.round
BOX = (0.0, 0.0, 110.0, 110.0)


def frames(t: Tables) -> DataFrame:
    """A square with a hole for each supplier, its corners running either way."""
    k = F.col("s_suppkey")
    x, y, n = (k * 7 % 90).cast("double"), (k * 13 % 90).cast("double"), (8 + k % 5).cast("double")
    ring = lambda a, b: F.array(F.array(x + a, y + a), F.array(x + b, y + a), F.array(x + b, y + b), F.array(x + a, y + b))
    outer = ring(F.lit(0.0), n)
    return t.supplier.select(k.alias("id"), F.array(F.when(k % 2 == 0, outer).otherwise(F.reverse(outer)), ring(F.lit(2.0), F.lit(4.0))).alias("rings"))


def lands(t: Tables) -> DataFrame:
    """A triangle for each region."""
    r = F.col("r_regionkey").cast("double")
    point = lambda x, y: F.array(x, y)
    return t.region.select(F.col("r_regionkey").alias("id"), F.array(F.array(point(10 * r, F.lit(0.0)), point(60 + 8 * r, F.lit(5.0)), point(F.lit(30.0), 95 - 10 * r))).alias("rings"))


SHAPES = """s as (select s_suppkey as id, ((s_suppkey * 7) % 90)::double as x, ((s_suppkey * 13) % 90)::double as y, (8 + s_suppkey % 5)::double as n from supplier),
fe(id, x1, y1, x2, y2, sign) as (select id, x, y + n, x + n, y + n, 1 from s union all select id, x, y, x + n, y, -1 from s union all select id, x + 2, y + 2, x + 4, y + 2, 1 from s union all select id, x + 2, y + 4, x + 4, y + 4, -1 from s),
lr as (select r_regionkey as id, r_regionkey::double as r from region), lc as (select id, [10 * r, 60 + 8 * r, 30.0] as xs, [0.0, 5.0, 95 - 10 * r] as ys from lr),
le as (select id, least(ax, bx) as x1, case when ax < bx then ay else by_ end as y1, greatest(ax, bx) as x2, case when ax < bx then by_ else ay end as y2, case when ax > bx then 1 else -1 end as sign from (
  select id, xs[i] as ax, ys[i] as ay, xs[i % 3 + 1] as bx, ys[i % 3 + 1] as by_ from lc, range(1, 4) k(i)) where ax <> bx)"""
SHARED = f"""{SHAPES}, met as (select f.id as a, l.id as b, f.sign * l.sign as sign, least(f.x2, l.x2) - greatest(f.x1, l.x1) as w, f.y1 as fl, f.y2 as fr,
  l.y1 + (l.y2 - l.y1) * (greatest(f.x1, l.x1) - l.x1) / (l.x2 - l.x1) as ll, l.y1 + (l.y2 - l.y1) * (least(f.x2, l.x2) - l.x1) / (l.x2 - l.x1) as lr from fe f join le l on f.x1 < l.x2 and l.x1 < f.x2),
parts as (select a, b, sign * w * case when (fl - ll) * (fr - lr) < 0 then ((least(fl, ll) + fl) * ((fl - ll) / ((fl - ll) - (fr - lr))) + (fl + least(fr, lr)) * (1 - (fl - ll) / ((fl - ll) - (fr - lr)))) / 2 else (least(fl, ll) + least(fr, lr)) / 2 end as area from met),
shared as (select a, b, sum(area) as area from parts group by a, b having sum(area) > 0.0000121)"""


@query("J22 M03 (overlay of polygons)", f"with {SHARED} select a as frame, b as land, round(area, 5) as area from shared")
def overlay_areas(t: Tables) -> DataFrame:
    """What squares with holes share with triangles that overlap each other."""
    return spatial.shared_areas(frames(t), lands(t), BOX, 3).select(F.col("a").alias("frame"), F.col("b").alias("land"), R("area", 5).alias("area"))


@query("M03 M02 (land of each county)", f"with {SHARED} select s.id, n * n - 4 as area, round(coalesce(shared.area, 0), 5) as inside from s left join shared on s.id = shared.a and shared.b = 0")
def land_shares(t: Tables) -> DataFrame:
    """The area of each square with a hole, and what of it lies on one land."""
    x = spatial.clipped_shares(frames(t), lands(t).where("id = 0"), BOX, 3)
    return x.select("id", R("area", 5).alias("area"), R("inside", 5).alias("inside"))


@query("J22 (points in polygons)", f"""with {SHAPES}, p as (select c_custkey as point, ((c_custkey * 37) % 1090)::double / 10 + 0.05 as x, ((c_custkey * 53) % 1090)::double / 10 + 0.05 as y from customer),
e as (select 'frame' as kind, * from fe union all select 'land', * from le)
select kind, id, count(*) as points from (select kind, id, point, sum(sign) as times from p join e on x1 <= x and x < x2 and y1 + (y2 - y1) * (x - x1) / (x2 - x1) > y group by all) where times > 0 group by all""")
def polygon_points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    points = t.customer.select(k.alias("point"), ((k * 37 % 1090) / 10 + 0.05).alias("x"), ((k * 53 % 1090) / 10 + 0.05).alias("y"))
    both = [spatial.holder_counts(points, shapes, BOX, 3).select(F.lit(kind).alias("kind"), "id", "points") for kind, shapes in (("frame", frames(t)), ("land", lands(t)))]
    return both[0].unionByName(both[1])


@query("J23 (three nearest)", f"""with {a.POINTS}, {a.TRACKS}, d as (select p.point_id, t.time_index, {a.HAVERSINE.format(a="p", b="t")} as km from points p, tracks t), r as (select *, row_number() over (partition by point_id order by round(km, 9), time_index) as place from d)
select point_id, round(sum(km), 6) as km, round(max(km), 6) as third_km from r where place <= 3 group by point_id""")
def three_nearest(t: Tables) -> DataFrame:
    """The three nearest track points of each point, by a quadtree."""
    x = spatial.neighbours(a.points(t).withColumnRenamed("point_id", "query"), a.tracks(t).withColumnRenamed("time_index", "id"), 3)
    return x.groupBy(F.col("query").alias("point_id")).agg(R(F.sum("km"), 6).alias("km"), R(F.max("km"), 6).alias("third_km"))


@query("H03 W01", f"with {a.TRACKS} select storm, row_number() over (partition by storm order by time_index) as place, time_index, lat, round(lon, 9) as lon, speed from tracks where storm % 2 = 0")
def track_extract(t: Tables) -> DataFrame:
    """The tracks of some storms in their order."""
    from pyspark.sql import Window as W

    x = a.tracks(t).where("storm % 2 = 0")
    place = F.row_number().over(W.partitionBy("storm").orderBy("time_index")).cast("long")
    return x.select("storm", place.alias("place"), "time_index", "lat", R("lon", 9).alias("lon"), "speed")


@query("F20", """select event_id, lpad(cast(hour(ts) * 100 + minute(ts) as varchar), 4, '0') as hhmm, substr(strftime(ts, '%Y%m%d'), 1, 4) as year, strftime(ts, '%Y%m%d') || ' ' || lpad(cast(hour(ts) * 100 + minute(ts) as varchar), 4, '0') as stamp from events""")
def padded_stamps(t: Tables) -> DataFrame:
    ts = F.col("ts")
    hhmm = F.lpad((F.hour(ts) * 100 + F.minute(ts)).cast("string"), 4, "0")
    date = F.concat(F.lpad(F.year(ts).cast("string"), 4, "0"), F.lpad(F.month(ts).cast("string"), 2, "0"), F.lpad(F.dayofmonth(ts).cast("string"), 2, "0"))
    return t.events.select("event_id", hhmm.alias("hhmm"), F.substring(date, 1, 4).alias("year"), F.concat(date, F.lit(" "), hhmm).alias("stamp"))


@query("ST06 H02", f"""select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by {uniform_sql("'29|' || event_id")}, event_id) as place from events) where place <= 120""")
def samples_by_group(t: Tables) -> DataFrame:
    return samples.bottom_k(t.events.select("event_type", "event_id"), ["event_type"], ["event_id"], 120, 29)


@query("B13 (zone table)", f"""with recursive {v.LOADS}, items as (select node, load_id, kw, row_number() over (partition by node order by is_critical desc, voll desc, kw desc, load_id) as i from loads),
r(node, i, total, load_id, kw, taken) as (select node, i, case when kw <= 3000 then kw else 0 end, load_id, kw, kw <= 3000 from items where i = 1 union all
  select t.node, t.i, r.total + case when r.total + t.kw <= 3000 then t.kw else 0 end, t.load_id, t.kw, r.total + t.kw <= 3000 from r join items t on t.node = r.node and t.i = r.i + 1),
z as (select node, '[' || string_agg(load_id, ',' order by load_id) || ']' as ids, sum(kw) / 1000 as mw from r where taken group by node), w as (select node, sum(kw) / 1000 as mw from loads group by node)
select 'zone_' || z.node as anchor_zone_id, z.node, ids as anchor_load_ids, round(z.mw, 6) as anchor_load_mw, round(z.mw / w.mw, 6) as anchor_load_share, round(least(2.5, z.mw), 6) as max_support_mw, round(least(2.5, z.mw) * 8, 6) as energy_budget_mwh from z join w using (node)""")
def anchor_zones(t: Tables) -> DataFrame:
    """The loads that each node's support stands for."""
    x = testbed.anchor_zones(v.loads(t), "node", 3000.0, 2.5, 8.0)
    numbers = ("anchor_load_mw", "anchor_load_share", "max_support_mw", "energy_budget_mwh")
    return x.select("anchor_zone_id", "node", "anchor_load_ids", *(R(c, 6).alias(c) for c in numbers))


@query("B03 (scan and selection)", f"""with c as ({QUERIES["candidate_regions"].sql}) select area, place, s_suppkey, score from (select n.s_nationkey as area, row_number() over (partition by n.s_nationkey order by c.score desc, c.s_suppkey) as place, c.s_suppkey, c.score from c join supplier n using (s_suppkey) where c.score >= 5) where place <= 2""")
def selected_candidates(t: Tables) -> DataFrame:
    """The two best-scored sites of each service area."""
    x = tables.candidate_regions(t).select("s_suppkey", R("score", 3).alias("score")).join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("area")), "s_suppkey")
    return testbed.selected_sites(x, "area", "score", "s_suppkey", 2, 5.0).withColumn("place", F.col("place").cast("long"))
