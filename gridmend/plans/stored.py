"""Queries that write tables with the sinks and read them back with the sources."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plane
from ..operators import network, publish, scratch, stages
from ..operators.scratch import scratch_path
from ..sources import arrays, fetch, files, workbook
from . import built
from . import views as v
from .catalog import query
from .views import Tables

R = F.round


@query("S01 S04 S23", "select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice from orders")
def csv_round_trip(t: Tables) -> DataFrame:
    """Orders as gzip files of comma-separated values, and back by a declared schema."""
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    path = scratch_path(t.spark, "csv")
    files.write_new(df, path, "csv", header="true", compression="gzip")
    return files.read_csv(t.spark, path, df.schema)


@query("S02", "select o_orderstatus, count(*) as n from orders group by 1")
def csv_pruned(t: Tables) -> DataFrame:
    """One column of four: the parser skips the others."""
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = scratch_path(t.spark, "csv")
    files.write_new(df, path, "csv", header="true")
    return files.read_csv(t.spark, path, df.schema, ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("S06 S07 S10", "select vec_id, len(embedding) as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total from embeddings")
def nested_profiles(t: Tables) -> DataFrame:
    """Arrays and a map in Parquet."""
    path = scratch_path(t.spark, "profiles")
    files.write_new(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("values"), F.create_map(F.lit("kind"), F.col("label").cast("string")).alias("about")), path)
    x = t.spark.read.parquet(path)
    return x.select("vec_id", F.size("values").cast("long").alias("n"), R(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("B10 S08 (three resolutions, one commit)", """with e as (select event_type, ts, value from events), r as (select 'quarter' as resolution, event_type, time_bucket(interval 15 minutes, ts, timestamp '1970-01-01') as t, value from e union all select 'hour', event_type, date_trunc('hour', ts), value from e union all select 'day', event_type, date_trunc('day', ts), value from e),
m as (select resolution, event_type, t, avg(value) as mean, count(*) as n from r group by all) select resolution, event_type, count(*) as windows, cast(sum(n) as bigint) as n, round(sum(mean * n), 4) as total from m group by all""")
def three_resolutions(t: Tables) -> DataFrame:
    """A month in two appends of three tables each; a third append that fails on the way leaves nothing."""
    rows = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    store = publish.Published(t.spark, scratch_path(t.spark, "published"))
    middle = F.lit("2024-01-15").cast("timestamp")

    def tables(part: DataFrame) -> dict[str, DataFrame]:
        x = scratch.cut(publish.rolled_up(part, "event_type", "ts", "value"), "rolled-up")
        return {name: x.where(F.col("resolution") == name) for name in publish.RESOLUTIONS}

    store.append(tables(rows.where(F.col("ts") < middle)))
    try:
        store.append({**tables(rows), "broken": rows.select(F.raise_error(F.lit("stopped")).alias("x"))})
    except Exception as e:  # whatever the failed task is wrapped in
        if "stopped" not in str(e):
            raise
    store.append(tables(rows.where(F.col("ts") >= middle)))
    each = [store.read(name) for name in publish.RESOLUTIONS]
    x = each[0].unionByName(each[1]).unionByName(each[2])
    return x.groupBy("resolution", "event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"), R(F.sum(F.col("mean") * F.col("n")), 4).alias("total"))


@query("S08 S24", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def appended_partitions(t: Tables) -> DataFrame:
    """Three appends to one table that is partitioned by type."""
    path = scratch_path(t.spark, "appended")
    rows = t.events.select("event_id", "event_type", "value")
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).write.mode("append").partitionBy("event_type").parquet(path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("total"))


@query("S11", "select s_suppkey, s_name, cast(s_nationkey as integer) as s_nationkey from supplier")
def json_round_trip(t: Tables) -> DataFrame:
    df = t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"))
    path = scratch_path(t.spark, "json")
    files.write_new(df, path, "json")
    return t.spark.read.schema(df.schema).json(path)


@query("S13", "select s_nationkey as nation, count(*) as n, round(sum(s_acctbal), 4) as total, max(place) as last from (select *, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as place from supplier) group by 1")
def number_files(t: Tables) -> DataFrame:
    """A file of numbers for each nation, with blank lines; places count the numbers only."""
    path = scratch_path(t.spark, "numbers")
    rows = t.supplier.select("s_nationkey", "s_suppkey", F.concat(F.col("s_acctbal").cast("string"), F.lit("\n")).alias("value"))
    rows.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").select("s_nationkey", "value").write.partitionBy("s_nationkey").text(path)
    x = files.read_numbers(t.spark, f"{path}/*/*.txt")
    nation = F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("long")
    return x.groupBy(nation.alias("nation")).agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("total"), F.max("place").cast("long").alias("last"))


@query("S14 B05", """with l as (select s_suppkey, 'l' || s_suppkey as name, 'b' || s_nationkey as bus1, 'b' || (s_nationkey + 1) as bus2, case when s_suppkey % 3 = 0 then 3 else 2 end as phases, s_suppkey / 10.0::double as length, s_suppkey % 4 as code from supplier)
select name, bus1, bus2, phases, length, case when s_suppkey % 5 = 0 then 0.75 when code < 3 then 0.25 + code else null end as r, case when s_suppkey % 5 = 0 then null when code < 3 then 0.5 + code else null end as x from l""")
def element_lines(t: Tables) -> DataFrame:
    """Line elements with comments, continued spellings and line codes; a line's own resistance wins, and a code that
    isn't there gives nothing. Where a line has its own resistance, its code isn't named."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = lambda c: c.cast("string")
    impedance = F.when(k % 5 == 0, F.lit(" r1=0.75")).otherwise(F.concat(F.lit(" LineCode=C"), s(k % 4)))
    phases = F.when(k % 3 == 0, F.lit(".1.2.3")).otherwise(F.lit(".1.2"))
    line = F.concat(F.lit("New Line.L"), s(k), F.lit(" bus1=B"), s(n), phases, F.lit(" bus2=B"), s(n + 1), phases, F.lit(" length="), s(k / 10.0), impedance, F.lit(" ! made up"))
    codes = t.spark.range(3).select(F.concat(F.lit('new "LineCode.C'), s(F.col("id")), F.lit('" r1='), s(F.col("id") + 0.25), F.lit(" x1="), s(F.col("id") + 0.5)).alias("value"))
    path = scratch_path(t.spark, "elements")
    t.supplier.select(line.alias("value")).unionByName(codes).write.text(path)
    return network.line_table(files.read_elements(t.spark, path))


@query("B05 (feeder votes)", """with l as (select l_suppkey as bus1, 100000 + l_partkey % 50 as bus2, l_returnflag as feeder from lineitem), s as (select bus, feeder, count(*) as n from (select bus1 as bus, feeder from l union all select bus2, feeder from l) group by all)
select bus, min_by(feeder, row(-n, feeder)) as feeder from s group by bus""")
def feeder_votes(t: Tables) -> DataFrame:
    return network.feeder_votes(t.lineitem.select(F.col("l_suppkey").alias("bus1"), (100_000 + F.col("l_partkey") % 50).alias("bus2"), F.col("l_returnflag").alias("feeder")))


@query("S15", "select 'n' || s_suppkey as bus, -(90 + s_suppkey % 7)::double as lon, (29 + s_suppkey % 3)::double as lat from supplier where s_suppkey % 11 > 0")
def coordinates(t: Tables) -> DataFrame:
    """Lines with a name and two numbers: some with commas, some turned, some without numbers."""
    k = F.col("s_suppkey")
    lon, lat = (F.concat(x.cast("string"), F.lit(".0")) for x in (-(90 + k % 7), 29 + k % 3))
    pair = F.when(k % 11 == 0, F.lit("x y")).when(k % 2 == 0, F.concat(lon, F.lit(" "), lat)).otherwise(F.concat(lat, F.lit(", "), lon))
    path = scratch_path(t.spark, "coordinates")
    t.supplier.select(F.concat(F.lit("N"), k.cast("string"), F.lit("  "), pair).alias("value")).write.text(path)
    return files.read_coordinates(t.spark, path)


@query("S16", "select n_name as name, cast(n_regionkey as varchar) as region from nation")
def script_rows(t: Tables) -> DataFrame:
    """The one array literal of a script."""
    row = F.concat(F.lit('{n:"'), F.col("n_name"), F.lit('",r:'), F.col("n_regionkey").cast("string"), F.lit("}"))
    body = t.nation.agg(F.array_join(F.collect_list(row), ", ").alias("rows"))  # 25 nations
    path = scratch_path(t.spark, "script")
    body.select(F.concat(F.lit("function f(){}var data=["), F.col("rows"), F.lit("];f(data)")).alias("value")).coalesce(1).write.text(path)
    return files.read_script_rows(t.spark, path, "data", r'\{n:"([^"]*)",r:(\d+)\}', ["name", "region"])


@query("S17", "select n_nationkey as id, n_regionkey as page, 5 as corners, n_nationkey % 2 = 0 as inside from nation")
def feature_pages(t: Tables) -> DataFrame:
    """Polygons in pages of features, and whether a point lies in each."""
    n = F.col("n_nationkey").cast("double")
    corner = lambda dx, dy: F.array(n + dx, n + dy)
    ring = F.array(corner(0, 0), corner(2, 0), corner(2, 2), corner(0, 2), corner(0, 0))
    feature = F.struct(F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("page")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    path = scratch_path(t.spark, "features")
    pages = t.nation.groupBy("n_regionkey").agg(F.collect_list(feature).alias("features"))  # 25 nations
    pages.select(F.lit("FeatureCollection").alias("type"), "features").repartition(2).write.json(path)
    x = files.read_features(t.spark, [path], "id long, page long", lines=True)
    at = F.col("id") + F.when(F.col("id") % 2 == 0, 1.0).otherwise(3.0)
    return x.select("id", "page", F.size(F.col("rings")[0]).alias("corners"), files.point_in_ring(at, at, F.col("rings")[0]).alias("inside"))


@query("S25", "select s_suppkey as id, round(-90 - s_nationkey / 10.0, 6) as lon, round(29 + s_suppkey % 5 / 10.0, 6) as lat from supplier")
def geojson_points(t: Tables) -> DataFrame:
    df = t.supplier.select(F.col("s_suppkey").alias("id"), (-90 - F.col("s_nationkey") / 10.0).alias("lon"), (29 + F.col("s_suppkey") % 5 / 10.0).alias("lat"))
    path = scratch_path(t.spark, "geojson")
    files.write_geojson(df, path)
    x = t.spark.read.text(path).select(F.from_json("value", "properties struct<id long>, geometry struct<coordinates array<double>>").alias("f"))
    return x.select("f.properties.id", R(F.col("f.geometry.coordinates")[0], 6).alias("lon"), R(F.col("f.geometry.coordinates")[1], 6).alias("lat"))


ROLES = "roles as (select o_orderpriority as role, string_agg(o_orderkey || '|' || o_orderstatus || chr(10), '' order by o_orderkey) as body, count(*) as n from orders group by 1)"


def _role_files(t: Tables) -> str:
    """A text file for each priority, orders sorted: by ranges of many tasks, whose files are then joined in their order."""
    path, ranges = scratch_path(t.spark, "runs"), scratch_path(t.spark, "ranges")
    rows = t.orders.select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), F.col("o_orderstatus")).alias("value"), F.col("o_orderpriority").alias("role"))
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "role", "o_orderkey").sortWithinPartitions("role", "o_orderkey").select("value", "role").write.partitionBy("role").text(ranges)
    parts: dict[str, list[str]] = {}
    for r in fetch.list_objects(t.spark, ranges).collect():  # a file for each priority and range, by the number of the range
        folder, _, name = r.path.rpartition("/")
        parts.setdefault(f"{path}/{folder.rpartition('/')[2]}/part-00000.txt", []).append(r.path)
    files.joined(t.spark, {k: sorted(x, key=lambda p: p.rpartition("/")[2]) for k, x in parts.items()})
    return path


@query("S19 S21 T01", f"with {ROLES} select role, sha256(body) as sha256, octet_length(encode(body)) as bytes, n as n_lines from roles")
def run_audit(t: Tables) -> DataFrame:
    """What was read: role, digest, bytes and lines of each file."""
    path = _role_files(t)
    role = F.regexp_extract(F.url_decode("path"), "role=([^/]+)", 1)
    listed = files.contents(t.spark, path).select(role.alias("role"), "sha256", F.col("length").alias("bytes"))
    counted = fetch.line_counts(t.spark, f"{path}/*/*.txt").select(role.alias("role"), "n_lines")
    return listed.join(counted, "role")


@query("S18 S20 S22 S28 B04", f"with {ROLES} select strip_accents(replace(role, ' ', '_')) as name, sha256(body) as sha256, octet_length(encode(body)) as bytes, 'fetched' as first, 'cached' as again from roles")
def pinned_files(t: Tables) -> DataFrame:
    """Files bundled with their digests, fetched by that manifest, and found again offline."""
    path = _role_files(t)
    listed = {r.path: r for r in fetch.list_objects(t.spark, path).collect()}  # a file for each priority
    names = {p.split("role=")[1].split("/")[0].replace("%20", "_").replace(" ", "_"): p for p in listed if p.endswith(".txt")}
    bundle = scratch_path(t.spark, "bundle")
    made = {r.name: r.sha256 for r in fetch.export_bundle(t.spark, names, bundle).collect()}
    manifest = [{"name": n, "url": f"{bundle}/{n}", "sha256": made[n]} for n in names]
    cache = scratch_path(t.spark, "cache")
    first = fetch.fetch_pinned(t.spark, manifest, cache).select("name", "sha256", "bytes", F.col("status").alias("first"))
    again = fetch.fetch_pinned(t.spark, manifest, cache, offline=True).select("name", F.col("status").alias("again"))
    return first.join(again, "name")


@query("S26", f"""with {ROLES} select '{{"seed":7}}' as arguments, count(*) as n_inputs, max(sha256(body)) as last from roles""")
def provenance(t: Tables) -> DataFrame:
    """One row on a run: its arguments and the digests of its inputs."""
    found = files.digests(t.spark, _role_files(t))
    path = scratch_path(t.spark, "provenance")
    files.write_provenance(t.spark, path, {"seed": 7}, found)
    x = t.spark.read.json(path).select("arguments", F.from_json("inputs", "array<struct<name string, sha256 string>>").alias("i"))
    return x.select("arguments", F.size("i").cast("long").alias("n_inputs"), F.array_max(F.transform("i", lambda r: r["sha256"])).alias("last"))


@query("S05 B01 B02", "select n_nationkey as id, n_name as name, cast(n_regionkey as varchar) as region from nation")
def workbook_sheet(t: Tables) -> DataFrame:
    """A sheet of a workbook with spaces in its headers, a column that isn't asked for, and a blank row."""
    rows = [[r.n_nationkey, "x", r.n_name, str(r.n_regionkey)] for r in t.nation.orderBy("n_nationkey").collect()]  # 25 nations
    path = scratch_path(t.spark, "book") + ".xlsx"
    fetch.write_bytes(t.spark, path, workbook.workbook({"About": [["nothing"]], "LoadMap": [[" id", "other", "name ", "region"], *rows[:9], [None, "", None, None], *rows[9:]]}))
    x = workbook.read_sheet(t.spark, path, "LoadMap", ["id", "name", "region"])
    return x.select(F.col("id").cast("double").cast("long").alias("id"), "name", "region")


@query("L14", "select s_suppkey as id, case when s_suppkey % 3 > 0 then s_acctbal end as reward, case when s_suppkey % 3 = 2 then s_nationkey else -1 end as extra from supplier")
def variable_logs(t: Tables) -> DataFrame:
    """Log rows of one to four fields: missing ones are null, further ones are dropped."""
    k = F.col("s_suppkey")
    line = F.concat_ws(",", k.cast("string"), F.when(k % 3 > 0, F.col("s_acctbal").cast("string")), F.when(k % 3 == 2, F.concat(F.col("s_nationkey").cast("string"), F.lit(",more"))))
    path = scratch_path(t.spark, "logs")
    t.supplier.select(line.alias("value")).write.text(path)
    return files.read_lenient(t.spark, path, "id long, reward double, extra long", header=False).withColumn("extra", F.coalesce("extra", F.lit(-1)))


METHODS = (stages.Method("greedy", "Greedy", "rule", False), stages.Method("learned", "Graph policy", "policy", True), stages.Method("ga", "Bounded search", "search", False))


@query("T07 B14 L13", f"""with {v.EPISODES}, m as (select * from (values ('greedy', 'Greedy', false), ('learned', 'Graph policy', true)) x(policy, label, learned))
select label, learned, count(*) as n, round(avg(damage), 4) as damage from episodes join m using (policy) group by all""")
def prepared_tables(t: Tables) -> DataFrame:
    """Two stages: episodes are checked before anything is written, then summed up by method."""
    known = stages.registry(METHODS)
    episodes = v.episodes(t)
    label = F.element_at(F.create_map(*(F.lit(x) for m in METHODS for x in (m.key, m.label))), F.col("policy"))
    learned = F.col("policy").isin([k for k, m in known.items() if m.learned])
    folder = scratch_path(t.spark, "tables")
    jobs = [
        stages.Stage("summary", {"summary": lambda: t.spark.read.parquet(f"{folder}/labelled").groupBy("label", "learned").agg(F.count("*").alias("n"), R(F.avg("damage"), 4).alias("damage"))}, after=("labels",)),
        stages.Stage("labels", {"labelled": lambda: episodes.select(label.alias("label"), learned.alias("learned"), "damage")}, {"unknown methods": lambda: episodes.where(~F.col("policy").isin(list(known))).select("policy"), "negative damage": lambda: episodes.where("not (damage >= 0)").select("scenario", "damage")}),
    ]
    return t.spark.read.parquet(stages.run(jobs, folder)["summary"])


@query("S09 S10", """select kind, n_nationkey as row, n_nationkey + f as first, (n_regionkey * f)::double as second from nation, (values ('npy', 1.0::double), ('npz', 2.0)) k(kind, f)""")
def array_files(t: Tables) -> DataFrame:
    """Two-dimensional arrays as a plain file and in an archive."""
    rows = [(r.n_nationkey, r.n_regionkey) for r in t.nation.orderBy("n_nationkey").collect()]  # 25 nations
    folder = scratch_path(t.spark, "arrays")
    for kind, f in (("npy", 1.0), ("npz", 2.0)):
        a, out = np.array([(k + f, g * f) for k, g in rows], np.float32), io.BytesIO()
        np.save(out, a) if kind == "npy" else np.savez(out, profiles=a)
        fetch.write_bytes(t.spark, f"{folder}/a.{kind}", out.getvalue())
    x = arrays.read_arrays(t.spark, f"{folder}/*")
    return x.select(F.substring("path", -3, 3).alias("kind"), "row", F.get("values", F.lit(0)).alias("first"), F.get("values", F.lit(1)).alias("second"))


@query("S17 (zipped shapefile)", "select n_name as name, cast(n_nationkey as varchar) as id, 4.0::double as area, (n_nationkey + 1)::double as x, (n_regionkey + 1)::double as y from nation")
def shape_records(t: Tables) -> DataFrame:
    """A square for each nation."""
    rows = []
    for r in t.nation.orderBy("n_nationkey").collect():  # 25 nations
        x, y = float(r.n_nationkey), float(r.n_regionkey)
        rows.append(({"NAME": r.n_name, "ID": str(r.n_nationkey)}, [[(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2), (x, y)]]))
    path = scratch_path(t.spark, "shapes") + ".zip"
    fetch.write_bytes(t.spark, path, arrays.shapefile(rows))
    ring = F.col("rings")[0]
    x, y = plane.centroid(ring)
    return arrays.read_shapes(t.spark, path, ["NAME", "ID"]).select(F.col("NAME").alias("name"), F.col("ID").alias("id"), R(plane.area(ring), 6).alias("area"), R(x, 6).alias("x"), R(y, 6).alias("y"))


ALBERS = """p as (select s_suppkey as id, radians(25 + s_suppkey % 200 / 10.0::double) as lat, radians(-110 + s_suppkey % 37::double + 96) as lon from supplier),
c as (select f * (2 - f) as e2 from (select 1 / 298.257222101::double as f)), e as (select e2, sqrt(e2) as e from c),
q as (select lat, (1 - e2) * (sin(lat) / (1 - e2 * sin(lat) * sin(lat)) - ln((1 - e * sin(lat)) / (1 + e * sin(lat))) / (2 * e)) as q, pow(cos(lat), 2) / (1 - e2 * sin(lat) * sin(lat)) as m from e, (select distinct lat from p union select radians(x::double) from (values (23.0), (29.5), (45.5)) v(x))),
k as (select (a.m - b.m) / (b.q - a.q) as n, a.m + (a.m - b.m) / (b.q - a.q) * a.q as c, o.q as q0 from q a, q b, q o where a.lat = radians(29.5::double) and b.lat = radians(45.5::double) and o.lat = radians(23.0::double))"""


@query("M03 (projection)", f"with {ALBERS} select id, round(6378137 * sqrt(c - n * q) / n * sin(n * lon), 2) as x, round(6378137 * sqrt(c - n * q0) / n - 6378137 * sqrt(c - n * q) / n * cos(n * lon), 2) as y from p join q using (lat), k")
def projected_points(t: Tables) -> DataFrame:
    """Metres in the conic equal-area projection of the conterminous states."""
    k = F.col("s_suppkey")
    x, y = plane.albers(-110 + (k % 37).cast("double"), 25 + k % 200 / 10.0)
    return t.supplier.select(k.alias("id"), R(x, 2).alias("x"), R(y, 2).alias("y"))


@query("M03 (clipping)", """with b as (select n_nationkey as id, greatest(n_nationkey, 5)::double as x1, least(n_nationkey + 4, 15)::double as x2, greatest(n_regionkey * 3, 4)::double as y1, least(n_regionkey * 3 + 4, 12)::double as y2 from nation)
select id, (x2 - x1) * (y2 - y1) as area, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y from b where x2 > x1 and y2 > y1""")
def clipped_land(t: Tables) -> DataFrame:
    """Squares clipped to a box, without those that keep no area, and a point for the label of each."""
    x, y = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double") * 3
    ring = F.array(F.array(x, y), F.array(x + 4, y), F.array(x + 4, y + 4), F.array(x, y + 4))
    kept = t.nation.select(F.col("n_nationkey").alias("id"), plane.clipped(ring, (5.0, 4.0, 15.0, 12.0)).alias("ring")).where(F.size("ring") > 2)
    kept = kept.withColumn("area", plane.area(F.col("ring"))).where("area > 0")
    at = plane.centroid(F.col("ring"))
    return kept.select("id", R("area", 6).alias("area"), R(at[0], 6).alias("x"), R(at[1], 6).alias("y"))


@query("M08", f"""with n as (select count(*) as n from customer where c_custkey > 1) select * from (select 'M06' as figure, count(distinct l_returnflag) * 4 as n_rows from lineitem union all select 'M07', n from n) where n_rows > 0""")
def figure_dispatch(t: Tables) -> DataFrame:
    """Figures' tables by name, each made by a stage of its own."""
    jobs = [stages.Stage("M06", {"M06": lambda: built.benefit_cost_figure(t)}), stages.Stage("M07", {"M07": lambda: built.schematic_segments(t)})]
    paths = stages.run(jobs, scratch_path(t.spark, "figures"), ["M07", "M06"])
    rows = [t.spark.read.parquet(p).agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("figure"), "n_rows") for k, p in sorted(paths.items())]
    return rows[0].unionByName(rows[1])
