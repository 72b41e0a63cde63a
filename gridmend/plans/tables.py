"""Queries on contracts, text sources, reshaping and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify, text
from ..functions import scalar as s
from ..operators import checks, quantiles, relational, scan
from . import views as v
from .catalog import query
from .views import Tables

R = F.round


@query("J05 J15", "select l_orderkey, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by 1")
def orphan_steps(t: Tables) -> DataFrame:
    lost = relational.orphans(t.lineitem.select("l_orderkey"), t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    return lost.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("U03 J09 J14", """with a as (select distinct l_suppkey as k, l_partkey % 50 as p from lineitem where l_quantity > 45), b as (select distinct l_suppkey as k, l_partkey % 50 as p from lineitem where l_discount > 0.09)
select k, p, 'left' as side from (select * from a except select * from b) union all select k, p, 'right' from (select * from b except select * from a)""")
def key_set_diff(t: Tables) -> DataFrame:
    x = t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("p"), "l_quantity", "l_discount")
    return relational.key_differences(x.where("l_quantity > 45"), x.where("l_discount > 0.09"), ["k", "p"])


@query("A13 J01 T08", "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(distinct (l_partkey, l_suppkey)) > 1")
def conflict_dups(t: Tables) -> DataFrame:
    return relational.conflicting(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])


@query("A12 W02 O06", "select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as i from customer) where i <= 3")
def first_rows_per_group(t: Tables) -> DataFrame:
    x = t.customer.select("c_nationkey", "c_custkey", "c_acctbal")
    return relational.first_rows(x, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query("W06 T02", f"""with {v.VISITS}, x as (select user_id, event_id, start, lag("end") over (partition by user_id order by start, event_id) as previous_end from visits)
select user_id, count(*) as breaks from x where abs(start - previous_end) > 1e-9 group by user_id""")
def contiguity(t: Tables) -> DataFrame:
    x = v.visits(t).withColumn("at", F.struct("start", "event_id"))
    return relational.contiguity_breaks(x, ["user_id"], "at", "start", "end").groupBy("user_id").agg(F.count("*").alias("breaks"))


@query("T02 T08 X04", f"""with {v.EPISODES} select subset, scenario, policy, 'energy adds up' as rule from episodes where abs(ens - steps * 0.0255) > 0.2 * steps * 0.0255 union all
select subset, scenario, policy, 'enough steps' from episodes where steps < 90""")
def contract_violations(t: Tables) -> DataFrame:
    e = v.episodes(t)
    mean = F.col("steps") * 0.0255
    return checks.broken(e, {"energy adds up": F.abs(F.col("ens") - mean) <= 0.2 * mean, "enough steps": F.col("steps") >= 90}, ["subset", "scenario", "policy"])


@query("T03", f"""with {v.EPISODES}, c as (select distinct policy, scenario from episodes where steps > 95), m as (select distinct policy from c where policy <> 'greedy'), w as (select policy, scenario from m, (select scenario from c where policy = 'greedy'))
select policy, scenario, 'left' as side from (select * from c where policy <> 'greedy' except select * from w) union all select policy, scenario, 'right' from (select * from w except select * from c where policy <> 'greedy')""")
def method_pairs(t: Tables) -> DataFrame:
    return checks.method_gaps(v.episodes(t).where("steps > 95"), ["scenario"], "policy", "greedy")


@query("W03 O01", "select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as i, count(*) over (partition by c_nationkey) as n from customer) where i <= greatest(1, ceil(0.045 * n))")
def topk_share_per_group(t: Tables) -> DataFrame:
    return relational.top_share(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 0.045, [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey")


@query("O03 O04 P09", f"""with {v.LOADS} select load_id, place from (select load_id, row_number() over (order by is_critical desc, voll desc, kw desc, load_id) as place from loads) where place <= 50""")
def priority_topk50(t: Tables) -> DataFrame:
    """The fifty loads that come first: a bounded sort in each task, then one over what is left."""
    best = v.loads(t).orderBy(F.desc("is_critical"), F.desc("voll"), F.desc("kw"), "load_id").limit(50)
    order = W.orderBy(F.desc("is_critical"), F.desc("voll"), F.desc("kw"), "load_id")
    return best.select("load_id", F.row_number().over(order).cast("long").alias("place"))


@query("W12 B13", """with recursive items as (select p_partkey as id, p_size % 5 as g, cast(p_retailprice as double) as size, row_number() over (partition by p_size % 5 order by p_retailprice desc, p_partkey) as i from part),
r(g, i, total, id, taken) as (select g, i, case when size <= 5000 then size else 0 end, id, size <= 5000 from items where i = 1 union all
  select t.g, t.i, r.total + case when r.total + t.size <= 5000 then t.size else 0 end, t.id, r.total + t.size <= 5000 from r join items t on t.g = r.g and t.i = r.i + 1)
select cast(g as integer) as g, id from r where taken""")
def prefix_under_cap_skip(t: Tables) -> DataFrame:
    x = t.part.select((F.col("p_size") % 5).alias("g"), (-F.col("p_retailprice")).alias("first"), F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("size"))
    return scan.take_under_cap(x, ["g"], "size", 5000.0, ["first", "id"]).select("g", "id")


@query("A14 A15 G08 G11", """with e as (select l_orderkey * 10 + l_linenumber as edge_id, l_suppkey as a, 100000000 + l_partkey as b, l_returnflag as edge_type, l_linestatus as feeder, cast(l_quantity as bigint) as length, l_tax > 0.05 as flag, l_discount > 0.08 as is_open from lineitem),
votes as (select a, b, edge_type, feeder, count(*) as n from e group by all), best as (select a, b, edge_type, min_by(feeder, row(-n, feeder)) as feeder from votes group by all)
select a, b, edge_type, best.feeder, length, flag, is_open, n_members from best join (select a, b, edge_type, cast(sum(length) as bigint) as length, max(flag) as flag, bool_or(is_open) as is_open, count(distinct edge_id) as n_members from e group by all) using (a, b, edge_type)""")
def edge_contraction(t: Tables) -> DataFrame:
    far, turned = 100_000_000 + F.col("l_partkey"), F.col("l_linenumber") % 2 == 0
    x = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.when(turned, far).otherwise(F.col("l_suppkey")).alias("from_node"), F.when(turned, F.col("l_suppkey")).otherwise(far).alias("to_node"), F.col("l_returnflag").alias("edge_type"), F.col("l_linestatus").alias("feeder"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_tax") > 0.05).alias("flag"), (F.col("l_discount") > 0.08).alias("is_open")
    )
    return relational.contracted(x).select("a", "b", "edge_type", "feeder", "length", "flag", "is_open", F.size(F.from_json("members", "array<long>")).cast("long").alias("n_members"))


@query("A16 A17 A18 A25 A26 A34", f"""with {v.LOADS} select node, count(*) as n, round(sum(kw), 5) as kw, round(max(kw), 5) as peak, bool_or(is_critical) as any_critical, count(distinct load_type) as n_types, round(sum(kw * load_id) / sum(kw), 6) as centre from loads group by node""")
def node_rollup(t: Tables) -> DataFrame:
    return v.loads(t).groupBy("node").agg(F.count("*").alias("n"), R(F.sum("kw"), 5).alias("kw"), R(F.max("kw"), 5).alias("peak"), F.bool_or("is_critical").alias("any_critical"), F.count_distinct("load_type").alias("n_types"), R(F.sum(F.col("kw") * F.col("load_id")) / F.sum("kw"), 6).alias("centre"))


@query("A10", f"""with {v.LOADS} select node, round(quantile_cont(kw, 0.95), 6) as p95 from loads group by node""")
def load_threshold_p95(t: Tables) -> DataFrame:
    return quantiles.quantiles(v.loads(t), ["node"], "kw", [0.95], ["p95"]).select("node", R("p95", 6).alias("p95"))


@query("W05", """with d as (select event_type, epoch_us(ts) // 86400000000 as day, avg(value / 200) as x from events group by 1, 2), w as (select *, row_number() over (partition by event_type order by day) as i, count(*) over (partition by event_type) as n, avg(x) over (partition by event_type order by day rows between 3 preceding and 3 following) as m from d)
select event_type, cast(day as bigint) as day, round(greatest(0, least(1, case when i <= 3 or i > n - 3 then x else m end)), 6) as smooth from w""")
def rolling7_edge_raw(t: Tables) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    d = t.events.groupBy("event_type", day.alias("day")).agg(F.avg(F.col("value") / 200).alias("x"))
    return relational.smoothed(d, ["event_type"], "day", "x").select("event_type", "day", R("smooth", 6).alias("smooth"))


@query("A32 S08", """select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2""")
def resample_hourly(t: Tables) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    return t.events.groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"), R(F.avg("value"), 6).alias("mean"))


@query("P23 F25", """select event_type, count(*) as n, round(sum(value), 4) as total from events where month(ts) = 1 and day(ts) = 15 group by 1""")
def representative_day(t: Tables) -> DataFrame:
    return t.events.where((F.month("ts") == 1) & (F.dayofmonth("ts") == 15)).groupBy("event_type").agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("total"))


@query("A33 S06 S09", """with parts as (select label, vec_id % 5 + 1 as w, embedding from embeddings), long as (select label, i, sum(w * embedding[i]::double) as x from parts, range(1, 65) r(i) group by 1, 2)
select label, count(*) as n, round(max(x), 5) as peak, round(avg(x), 5) as mean from long group by label""")
def profile_linear_combination(t: Tables) -> DataFrame:
    parts = t.embeddings.select("label", (F.col("vec_id") % 5 + 1).alias("w"), F.col("embedding").cast("array<double>").alias("profile"))
    c = relational.profile_combination(parts, ["label"], "w", "profile")
    return c.select("label", F.size("profile").cast("long").alias("n"), R("peak", 5).alias("peak"), R("mean", 5).alias("mean"))


@query("P02 A20 A21", f"""with {v.LOADS}, {v.DAMAGE}, m as (select scenario, count(distinct node) as islands, sum(kw) / 1000 as mw, max(repair_h) as longest from damage join loads using (node) group by 1),
flags as (select scenario, mw > 0.05 as is_nonzero, mw > 250 as is_severe, islands > 8 as is_multi_island, longest > 5 as is_long from m)
select flag, count(*) as n, cast(sum(case when on_ then 1 else 0 end) as bigint) as n_on from (select scenario, 'is_nonzero' as flag, is_nonzero as on_ from flags union all select scenario, 'is_severe', is_severe from flags union all select scenario, 'is_multi_island', is_multi_island from flags union all select scenario, 'is_long', is_long from flags) group by flag""")
def scenario_flags_unpivot(t: Tables) -> DataFrame:
    m = v.damage(t).join(v.loads(t), "node").groupBy("scenario").agg(F.count_distinct("node").alias("islands"), (F.sum("kw") / 1000).alias("mw"), F.max("repair_h").alias("longest"))
    flags = m.select("scenario", (F.col("mw") > 0.05).alias("is_nonzero"), (F.col("mw") > 250).alias("is_severe"), (F.col("islands") > 8).alias("is_multi_island"), (F.col("longest") > 5).alias("is_long"))
    long = relational.melted(flags, ["scenario"], [c for c in flags.columns if c != "scenario"], "flag", "is_on")
    return long.groupBy("flag").agg(F.count("*").alias("n"), F.sum(F.col("is_on").cast("long")).alias("n_on"))


@query("A27 M01", """select l_returnflag as flag, cast(sum(case when year(l_shipdate) = 1996 then cast(l_quantity as bigint) end) as bigint) as y1996, cast(sum(case when year(l_shipdate) = 1999 then cast(l_quantity as bigint) end) as bigint) as y1999,
  round(100.0 * sum(case when year(l_shipdate) = 1999 then cast(l_quantity as bigint) end) / sum(case when year(l_shipdate) = 1996 then cast(l_quantity as bigint) end) - 100, 6) as growth_pct from lineitem where year(l_shipdate) in (1996, 1999) group by 1""")
def pivot_growth(t: Tables) -> DataFrame:
    x = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("long").alias("q")).where("year in (1996, 1999)")
    p = relational.pivoted(x, ["flag"], "year", [1996, 1999], "q")
    return p.select("flag", F.col("1996").alias("y1996"), F.col("1999").alias("y1999"), R(100.0 * F.col("1999") / F.col("1996") - 100, 6).alias("growth_pct"))


@query("A23 U01", """with parts as (select l_returnflag as part, sum(cast(l_quantity as bigint)) as q from lineitem group by 1), whole as (select sum(cast(l_quantity as bigint)) as q from lineitem)
select part, round(cast(parts.q as double) / whole.q, 9) as share, abs((select sum(q) from parts) - whole.q) <= 0.026 as reconciled from parts, whole""")
def reconcile_totals(t: Tables) -> DataFrame:
    parts = t.lineitem.groupBy(F.col("l_returnflag").alias("part")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    whole = t.lineitem.agg(F.sum(F.col("l_quantity").cast("long")).alias("all"))
    added = parts.agg(F.sum("q").alias("added"))
    met = parts.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(added))  # one row each
    return met.select("part", R(F.col("q").cast("double") / F.col("all"), 9).alias("share"), (F.abs(F.col("added") - F.col("all")) <= 0.026).alias("reconciled"))


@query("S14 F23", r"""with lines as (select s_suppkey, 'New Line.' || replace(s_name, '#', '_') || ' bus1=b' || s_nationkey || '.1.2 length=' || s_acctbal || ' units="km" ! note=1' as line from supplier)
select s_suppkey, lower(regexp_extract(line, '^New (\w+)\.(\S+)', 1)) as class, lower(regexp_extract(line, '^New (\w+)\.(\S+)', 2)) as name, regexp_extract(line, 'bus1=([^\s.]+)', 1) as bus, cast(regexp_extract(line, 'length=(\S+)', 1) as double) as length, 3 as n_tokens from lines""")
def parse_kv_lines(t: Tables) -> DataFrame:
    line = F.concat(F.lit("New Line."), F.replace("s_name", F.lit("#"), F.lit("_")), F.lit(" bus1=b"), F.col("s_nationkey").cast("string"), F.lit(".1.2 length="), F.col("s_acctbal").cast("string"), F.lit(' units="km" ! note=1'))
    x = t.supplier.select("s_suppkey", text.without_comment(line).alias("line")).withColumns({"e": text.element(F.col("line")), "t": text.tokens(F.col("line"))})
    get = lambda k: F.filter("t", lambda p: p["key"] == k)[0]["value"]
    return x.select("s_suppkey", F.col("e.class").alias("class"), F.col("e.name").alias("name"), s.bus_name(get("bus1")).alias("bus"), s.numeric_or_null(get("length")).alias("length"), F.size("t").alias("n_tokens"))


@query("F19 S11", """select cast(json_extract(props, '$.k') as integer) as k, count(*) as n from events group by 1""")
def json_members(t: Tables) -> DataFrame:
    return t.events.select(F.from_json("props", "k int").k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("S16 F21 F22", r"""select page_id, len(regexp_extract_all(html, '<p>')) as paragraphs, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as links, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') as slug, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages""")
def regex_rows(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), s.identifier(F.col("url")).alias("slug"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("S21 S22", "select doc_id, sha256(text) as digest, octet_length(encode(text)) as n_bytes from documents")
def manifest_sha(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.col("text"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("F28 L07 F27", f"""with {v.LOADS}, b as (select min(kw) as lo, max(kw) as hi, min(load_id) as l, max(load_id) as h from loads)
select cast(greatest(0, least(31, floor((kw - lo) / greatest(hi - lo, 1e-9) * 32))) as integer) as cy, cast(greatest(0, least(31, floor((load_id - l) / greatest(h - l, 1e-9) * 32))) as integer) as cx, count(*) as n, round(sum(kw), 5) as kw from loads, b group by 1, 2""")
def raster_cells(t: Tables) -> DataFrame:
    x = v.loads(t)
    b = x.agg(F.min("kw").alias("lo"), F.max("kw").alias("hi"), F.min("load_id").alias("l"), F.max("load_id").alias("h"))
    met = x.crossJoin(F.broadcast(b))  # one row
    return met.groupBy(s.cell(F.col("kw"), F.col("lo"), F.col("hi"), 32).alias("cy"), s.cell(F.col("load_id"), F.col("l"), F.col("h"), 32).alias("cx")).agg(F.count("*").alias("n"), R(F.sum("kw"), 5).alias("kw"))


@query("S27 U01 U02 J10", """select c_custkey as load_id, c_nationkey as node, 'base' as layer, cast(null as double) as export_mw from customer where c_mktsegment <> 'BUILDING' union all select 1000000 + s_suppkey, s_nationkey, 'overlay', round(greatest(s_acctbal, 0) / 1000, 6) from supplier""")
def overlay_union(t: Tables) -> DataFrame:
    base = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("load_id"), F.col("c_nationkey").alias("node"), F.lit("base").alias("layer"))
    over = t.supplier.select((1000000 + F.col("s_suppkey")).alias("load_id"), F.col("s_nationkey").alias("node"), F.lit("overlay").alias("layer"), R(F.greatest("s_acctbal", F.lit(0.0)) / 1000, 6).alias("export_mw"))
    return base.unionByName(over, allowMissingColumns=True).select("load_id", "node", "layer", "export_mw")


@query("U06 T09", "select l_orderkey * 10 + l_linenumber as edge_id, l_partkey as node from lineitem where l_partkey not in (select p_partkey from part where p_size < 40)")
def missing_endpoints(t: Tables) -> DataFrame:
    x = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("node"))
    return x.join(t.part.where("p_size < 40").select(F.col("p_partkey").alias("node")), "node", "left_anti").select("edge_id", "node")


@query("G05", "select node, count(distinct other) as degree from (select l_suppkey as node, 1000 + l_partkey % 97 as other from lineitem union all select 1000 + l_partkey % 97, l_suppkey from lineitem) where node <> other group by node")
def degree(t: Tables) -> DataFrame:
    from ..operators.graph import degrees

    return degrees(t.lineitem.select(F.col("l_suppkey").alias("a"), (1000 + F.col("l_partkey") % 97).alias("b")))


@query("P05 P09 P17 P18 P20", f"""with {v.LOADS} select load_id, case when load_type = 'residential' then 'residential' when kw * 8.76 * 0.62 <= 50 then 'small_commercial' when kw * 8.76 * 0.62 <= 1000 then 'medium_commercial' else 'large_commercial' end as band,
  load_type || case when is_critical then '_critical' else '_noncritical' end as valuation, round(kw * 1.25, 6) as peak_kw, round(kw * 0.62, 6) as average_kw, round(greatest(4, least(16, 4 + 2 * kw / 100)), 6) as repair_h from loads""")
def load_inventory(t: Tables) -> DataFrame:
    kw = F.col("kw")
    return v.loads(t).select("load_id", s.size_band(kw * 8.76 * 0.62, F.col("load_type")).alias("band"), s.valuation_group(F.col("load_type"), F.col("is_critical")).alias("valuation"), R(kw * 1.25, 6).alias("peak_kw"), R(kw * 0.62, 6).alias("average_kw"), R(s.clip(4 + 2 * kw / 100, 4.0, 16.0), 6).alias("repair_h"))


@query("P03 F24 P22", """select p_partkey, case p_partkey % 6 when 0 then 'true' when 1 then 'false' when 2 then 'true' when 3 then 'false' else 'unknown' end as token, p_partkey % 6 in (0, 2) as lenient, cast(p_size as double) as number from part""")
def coercions(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*(F.lit(x) for x in ("Yes", "no", " TRUE", "n", "maybe", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select("p_partkey", F.coalesce(s.boolean_token(word).cast("string"), F.lit("unknown")).alias("token"), s.lenient_boolean(word).alias("lenient"), s.numeric_or_null(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).alias("number"))


@query("S03 P20 J12", "select o_orderkey, case o_orderpriority when '1-URGENT' then 'urgent' when '5-LOW' then 'low' else o_orderpriority end as label from orders")
def display_labels(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("label")).replace({"1-URGENT": "urgent", "5-LOW": "low"}, subset=["label"])


@query("P06 P07 P08", """select l_orderkey, l_linenumber, l_partkey, not (l_discount > 0.08) and l_partkey % 5 in (0, 1) and l_tax > 0.02 as eligible,
  case when l_discount > 0.08 then 'excluded_equivalent_connection' when l_partkey % 5 = 0 and l_tax > 0.02 then 'legacy_pole_fragility_adapted_to_overhead_distribution_edge' when l_partkey % 5 = 1 and l_tax > 0.02 then 'legacy_conductor_fragility'
    when l_partkey % 5 = 2 then 'unsupported_underground_line' when l_partkey % 5 = 3 then 'unsupported_transformer' when l_partkey % 5 = 4 then 'unsupported_switch' else 'not_applicable' end as model
from lineitem""")
def edge_classes(t: Tables) -> DataFrame:
    kinds = ("overhead_distribution_line", "transmission_line", "underground_distribution_line", "transformer", "switch")
    kind = F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("l_partkey") % 5 + 1).cast("int"))
    c = classify.edge_component(kind, F.lit("other"), F.col("l_discount") > 0.08, F.col("l_tax") > 0.02, list(kinds[:2]))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c["eligible"].alias("eligible"), c["model"].alias("model"))


@query("P09 P10 P11", """select p_partkey, case when p_type = 'ECONOMY' then 'residential' when p_type = 'STANDARD' then 'commercial' else 'unknown' end as class,
  case when p_size = 1 then 0 when p_size < 5 then 1 when p_type = 'ECONOMY' then 4 when p_type = 'STANDARD' then 3 else 5 end as priority, p_size % 2 = 0 as overhead, p_size % 2 = 1 as underground from part""")
def customer_classes(t: Tables) -> DataFrame:
    profile = F.when(F.col("p_type") == "ECONOMY", "res_17").when(F.col("p_type") == "STANDARD", "x com_3").otherwise("other")
    kind = classify.customer_class(profile, F.lit("n"))
    over, under = classify.installation(F.when(F.col("p_size") % 2 == 0, "4/0_oh").otherwise("ug_250"))
    return t.part.select("p_partkey", kind.alias("class"), classify.priority(kind, F.col("p_size") < 5, F.col("p_size") == 1).alias("priority"), over.alias("overhead"), under.alias("underground"))


@query("P12 P13 P15 B03", """with x as (select s_suppkey, s_acctbal / 20 as coast, s_nationkey % 3 as f, s_suppkey * 10 as n, s_acctbal / 100 as mw, 20.0 + s_suppkey / 10.0 as lat from supplier)
select s_suppkey, round(case when coast <= 80 then 3.0 when coast <= 150 then 2.0 when coast <= 250 then 1.0 else 0 end + 2.0 + case when f >= 2 then 2.0 when f = 1 then 1.0 else 0 end + case when n between 300 and 600 then 3.0 when n >= 200 then 2.0 when n >= 100 then 0.5 else 0 end
  + case when mw >= 80 then 2.0 when mw >= 30 then 1.0 else 0 end + case when n * 4 > 2400 then -2.0 when n * 4 > 1800 then -1.0 else 0 end, 3) as score,
  case when lat between 22 and 24 then 'a' when lat between 25 and 27 then 'b' when lat between 21.5 and 24.5 then 'a_expanded' when lat between 24.5 and 27.5 then 'b_expanded' end as region from x""")
def candidate_regions(t: Tables) -> DataFrame:
    bal, n, lat = F.col("s_acctbal"), F.col("s_suppkey") * 10, 20.0 + F.col("s_suppkey") / 10.0
    score = classify.candidate_score(bal / 20, F.lit(69.0), F.col("s_nationkey") % 3, n, bal / 100, n * 4, lat, lat, (300, 600), 200, 800)
    boxes = {"a": (22.0, -100.0, 24.0, 0.0), "b": (25.0, -100.0, 27.0, 0.0)}
    return t.supplier.select("s_suppkey", score.alias("score"), classify.region_of(lat, F.lit(-95.0), boxes, 0.5).alias("region"))
