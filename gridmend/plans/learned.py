"""Queries on observations, labels and message passing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learning, tensors
from . import views as v
from .catalog import query
from .views import Tables

R = F.round
MATRIX, BIAS = ((0.5, -0.25, 0.125), (-1.0, 0.75, 0.5)), (0.1, -0.2)


@query("G12 L08", f"""with {v.LOADS}, {v.NODE_POWER}, nodes as (select n_nationkey as node, n_regionkey, coalesce(kw, 0) / 10000 as x0, coalesce(critical_kw, 0) / 10000 as x1 from nation left join node_power on node = n_nationkey),
edges as (select a.n_nationkey as a, b.n_nationkey as b, (b.n_nationkey - a.n_nationkey) / 25.0 as e from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey),
sent as (select s.tgt, greatest(0, 0.5 * x0 - 0.25 * x1 + 0.125 * e + 0.1) as m0, greatest(0, -x0 + 0.75 * x1 + 0.5 * e - 0.2) as m1 from (select a as tgt, b as node, e from edges union all select b, a, e from edges) s join nodes using (node)),
mean as (select tgt as node, avg(m0) as m0, avg(m1) as m1 from sent group by 1)
select cast(node as bigint) as node, round(x0 + coalesce(m0, 0), 6) as h0, round(x1 + coalesce(m1, 0), 6) as h1 from nodes left join mean using (node)""")
def message_passing(t: Tables) -> DataFrame:
    """One round over nations, neighbours within a region."""
    power = v.node_power(t)
    nodes = t.nation.select(F.col("n_nationkey").cast("long").alias("node")).join(power, "node", "left")
    nodes = nodes.select("node", F.array(*(F.coalesce(k, F.lit(0.0)) / 10000 for k in ("kw", "critical_kw"))).alias("x"))
    n = t.nation.select("n_regionkey", F.col("n_nationkey").cast("long").alias("n"))
    pairs = n.withColumnRenamed("n", "a").join(n.withColumnRenamed("n", "b"), "n_regionkey").where("a < b")
    edges = pairs.select("a", "b", F.array((F.col("b") - F.col("a")) / 25.0).alias("e"))
    out = learning.message_passing(nodes, edges, MATRIX, BIAS)
    return out.select("node", R(F.get("x", F.lit(0)), 6).alias("h0"), R(F.get("x", F.lit(1)), 6).alias("h1"))


@query("L05 O03 P02", f"""with {v.LOADS}, {v.DAMAGE}, {v.NODE_POWER}, r as (select scenario, node, kw, repair_h, row_number() over (partition by scenario order by kw desc, node) as i from damage join node_power using (node)),
s as (select scenario, count(*) as n, string_agg(cast(node as varchar), ',' order by i) as ids, sum(kw * i) as checksum from r where i <= 8 group by scenario)
select scenario, n as n_valid, ids || repeat(',-1', cast(8 - n as integer)) as ids, round(checksum, 4) as checksum from s""")
def padded_observation(t: Tables) -> DataFrame:
    """Eight candidates of each scenario as arrays with a mask."""
    scored = v.damage(t).join(v.node_power(t), "node")
    x = learning.padded_candidates(scored, ["scenario"], [F.desc("kw"), F.col("node")], ["kw", "repair_h"], "node", 8)
    checksum = F.aggregate(F.transform("features", lambda f, i: F.get(f, F.lit(0)) * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    valid = F.size(F.filter("mask", lambda m: m)).cast("long")
    return x.select("scenario", valid.alias("n_valid"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), R(checksum, 4).alias("checksum"))


@query("L06 O02", f"""with {v.LOADS}, {v.DAMAGE}, {v.NODE_POWER}, c as (select scenario, node, repair_h * (sum(kw) over (partition by scenario)) / 1000 - kw / 100 as cost from damage join node_power using (node))
select scenario, min_by(node, row(cost, node)) as label, round(min(cost), 9) as best, round(avg(cost) - min(cost), 3) as spread from c group by scenario""")
def lookahead_labels(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    met = v.damage(t).join(v.node_power(t), "node")
    cost = F.col("repair_h") * F.sum("kw").over(W.partitionBy("scenario")) / 1000 - F.col("kw") / 100
    x = learning.lookahead_labels(met.withColumn("cost", cost), ["scenario"], "cost", "node")
    return x.select("scenario", "label", R("best", 9).alias("best"), R("spread", 3).alias("spread"))


@query("L12", """with s as (select l_suppkey as k, row_number() over (partition by l_suppkey order by l_quantity desc, l_extendedprice) as i, l_extendedprice as c, min(l_extendedprice) over (partition by l_suppkey) as m from lineitem),
p as (select k, min(case when c = m then i end) as place, min(case when i = 1 then c end) - min(m) as regret from s group by k)
select count(*) as n, round(avg(case when place <= 1 then 1.0 else 0 end), 6) as top1, round(avg(case when place <= 300 then 1.0 else 0 end), 6) as top300, round(avg(regret), 4) as regret from p""")
def ranking_metrics(t: Tables) -> DataFrame:
    x = learning.ranking_metrics(t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"], "l_quantity", "l_extendedprice", ks=(1, 300))
    return x.select("n", R("top1", 6).alias("top1"), R("top300", 6).alias("top300"), R("regret", 4).alias("regret"))


@query("W15 (advantage estimates)", """with recursive e as (select o_custkey as k, o_orderkey, cast(o_orderkey % 17 as double) as r, cast(o_orderkey % 5 as double) as v, row_number() over (partition by o_custkey order by o_orderkey desc) as i from orders),
f(k, i, o_orderkey, run, after) as (select k, i, o_orderkey, r - v, v from e where i = 1 union all
  select e.k, e.i, e.o_orderkey, e.r + 0.5 * f.after - e.v + 0.25 * f.run, e.v from f join e on e.k = f.k and e.i = f.i + 1)
select k, o_orderkey, round(run, 7) as advantage from f""")
def advantages(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    steps = t.orders.select(F.col("o_custkey").alias("k"), o, (o % 17).alias("r"), (o % 5).alias("v"))
    return learning.discounted_advantages(steps, ["k"], "o_orderkey", "r", "v", 0.5, 0.5).select("k", "o_orderkey", R("advantage", 7).alias("advantage"))


@query("L05 (edge tensors)", """with e as (select o_custkey as state, l_partkey as a, l_suppkey + 1000000 as b, l_quantity as x from lineitem join orders on l_orderkey = o_orderkey), n as (select state, node, row_number() over (partition by state order by node) - 1 as i from (select distinct state, unnest([a, b]) as node from e)),
m as (select e.state, s.i as source, t.i as target, x from e join n s on s.state = e.state and s.node = e.a join n t on t.state = e.state and t.node = e.b)
select state, (select count(*) from n where n.state = m.state) as n_nodes, count(*) as n_edges, cast(ceil(count(*) / 8.0) * 8 as bigint) as padded, cast(sum(source * 1000 + target) as bigint) as indices, round(sum(x * (target + 1)), 4) as weighed from m group by state""")
def edge_tensors(t: Tables) -> DataFrame:
    """The parts and suppliers of each customer's orders as a graph in arrays."""
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("state"))
    edges = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b"), "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    x = tensors.packed(edges, "state", "a", "b", ["l_quantity"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, y: s + y)
    at = F.zip_with("source", "target", lambda p, q: (p * 1000 + q).cast("double"))
    weighed = F.zip_with("target", "features", lambda q, f: (q + 1) * f[0])
    return x.select("state", F.col("n_nodes").cast("long").alias("n_nodes"), F.col("n_edges").cast("long").alias("n_edges"), F.size("mask").cast("long").alias("padded"), total(at).cast("long").alias("indices"), R(total(weighed), 4).alias("weighed"))
