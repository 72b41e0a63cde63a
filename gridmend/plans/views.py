"""Domain views over the test tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of one folder, read lazily; only the columns that a plan uses reach the scan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def loads(t: Tables) -> DataFrame:
    c = t.customer
    critical = F.col("c_mktsegment") == "MACHINERY"
    home = F.col("c_mktsegment") == "HOUSEHOLD"
    return c.select(
        F.col("c_custkey").alias("load_id"),
        F.col("c_nationkey").cast("long").alias("node"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10 + 1).alias("kw"),
        F.when(home, "residential").otherwise("commercial").alias("load_type"),
        critical.alias("is_critical"),
        F.when(critical, 100.0).when(home, 10.0).otherwise(25.0).alias("voll"),
    )


LOADS = """loads as (
  select c_custkey as load_id, cast(c_nationkey as bigint) as node, greatest(c_acctbal, 0) / 10 + 1 as kw,
    case when c_mktsegment = 'HOUSEHOLD' then 'residential' else 'commercial' end as load_type,
    c_mktsegment = 'MACHINERY' as is_critical,
    cast(case when c_mktsegment = 'MACHINERY' then 100 when c_mktsegment = 'HOUSEHOLD' then 10 else 25 end as double) as voll
  from customer)"""


def damage(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    scenario = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    met = urgent.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy(scenario.cast("long").alias("scenario"), F.col("c_nationkey").cast("long").alias("node")).agg((2 + F.min(F.dayofmonth("o_orderdate")).cast("double") / 4).alias("repair_h"))


DAMAGE = """damage as (
  select cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as scenario, cast(c_nationkey as bigint) as node,
    2 + cast(min(day(o_orderdate)) as double) / 4 as repair_h
  from orders join customer on o_custkey = c_custkey
  where o_orderpriority = '1-URGENT' and o_orderstatus = 'F' group by 1, 2)"""


def node_power(t: Tables) -> DataFrame:
    return loads(t).groupBy("node").agg(F.sum("kw").alias("kw"), F.sum(F.when(F.col("is_critical"), F.col("kw")).otherwise(0.0)).alias("critical_kw"))


NODE_POWER = "node_power as (select node, sum(kw) as kw, sum(case when is_critical then kw else 0 end) as critical_kw from loads group by node)"


def episodes(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("subset"),
        F.col("l_suppkey").alias("scenario"),
        F.when(F.col("l_linestatus") == "F", "greedy").otherwise("learned").alias("policy"),
    ).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100).alias("damage"), (F.sum(F.round("l_quantity").cast("long")) / 1000).alias("ens"), F.count("*").alias("steps"))


EPISODES = """episodes as (
  select l_returnflag as subset, l_suppkey as scenario, case when l_linestatus = 'F' then 'greedy' else 'learned' end as policy,
    sum(cast(round(l_extendedprice * 100) as bigint)) / 100 as damage, sum(cast(round(l_quantity) as bigint)) / 1000 as ens, count(*) as steps
  from lineitem group by 1, 2, 3)"""


def trajectory(t: Tables) -> DataFrame:
    """Repairs by scenario in the order of duration: what is unserved while each goes on, and what adds up."""
    from pyspark.sql import Window as W

    order = W.partitionBy("scenario").orderBy("repair_h", "node")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = order.rowsBetween(0, W.unboundedFollowing)
    met = damage(t).join(node_power(t), "node")
    steps = met.select(
        "scenario",
        "node",
        (F.row_number().over(order) - 1).alias("step_index"),
        F.col("repair_h").alias("duration_h"),
        F.sum("repair_h").over(so_far).alias("end_h"),
        (F.sum("kw").over(ahead) / 1000).alias("unserved_mw"),
        (F.sum("critical_kw").over(ahead) / 1000).alias("critical_mw"),
        (F.sum("kw").over(W.partitionBy("scenario")) / 1000).alias("initial_mw"),
    )
    steps = steps.withColumns({"start_h": F.col("end_h") - F.col("duration_h"), "step_ens": F.col("unserved_mw") * F.col("duration_h"), "service": 1 - F.col("unserved_mw") / F.col("initial_mw")})
    return steps.withColumn("cum_ens", F.sum("step_ens").over(W.partitionBy("scenario").orderBy("step_index").rowsBetween(W.unboundedPreceding, W.currentRow)))


TRAJECTORY = f"""{LOADS}, {DAMAGE}, {NODE_POWER}, ranked as (
  select scenario, node, row_number() over w - 1 as step_index, repair_h as duration_h,
    sum(repair_h) over (w rows between unbounded preceding and current row) as end_h,
    sum(kw) over (w rows between current row and unbounded following) / 1000 as unserved_mw,
    sum(critical_kw) over (w rows between current row and unbounded following) / 1000 as critical_mw,
    sum(kw) over (partition by scenario) / 1000 as initial_mw
  from damage join node_power using (node) window w as (partition by scenario order by repair_h, node)),
trajectory as (
  select *, end_h - duration_h as start_h, unserved_mw * duration_h as step_ens, 1 - unserved_mw / initial_mw as service,
    sum(unserved_mw * duration_h) over (partition by scenario order by step_index rows between unbounded preceding and current row) as cum_ens
  from ranked)"""


def visits(t: Tables) -> DataFrame:
    """Intervals in hours that events of a user and type are taken to last."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9) - 473_352.0
    return t.events.select("event_id", "user_id", "event_type", "value", start.alias("start"), (start + F.col("value") / 10).alias("end"))


VISITS = "visits as (select event_id, user_id, event_type, value, epoch_us(ts) / 3.6e9 - 473352.0 as start, epoch_us(ts) / 3.6e9 - 473352.0 + value / 10 as \"end\" from events)"
