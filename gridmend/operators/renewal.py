"""Renewal histories of units as columns: keyed draws, and times as running sums of cycle lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.draws import uniform
from .scratch import cut

#: Cycles that a unit goes through in one round.
ROUND = 16


def waiting(mean: Column | float, u: Column) -> Column:
    return -F.lit(mean) * F.ln(u) if isinstance(mean, (int, float)) else -mean * F.ln(u)


def cycles(units: DataFrame, first: Column, length: Callable[[Column], Column], horizon: float) -> DataFrame:
    """The columns of ``units`` with (n, at): the number and the start of each cycle that begins before ``horizon``.

    ``first`` is when cycle 0 begins, ``length`` how long cycle n takes; both are columns of ``units``. Units are dealt out once, as
    a table of few bytes is one split and its histories much work. A unit's next cycles are an array in its row, which ends at the horizon,
    and only units that haven't reached it go into another round.
    """
    names, done = units.columns, []
    units = units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)
    open_ = units.select("*", F.lit(0).cast("long").alias("gm_n"), first.alias("gm_at"))
    while True:
        numbers = F.sequence(F.col("gm_n"), F.col("gm_n") + ROUND - 1)
        longer = lambda a, n: F.when(F.element_at(a, -1) < horizon, F.concat(a, F.array(F.element_at(a, -1) + length(n)))).otherwise(a)
        begun = F.aggregate(numbers, F.array("gm_at"), longer)
        rows = cut(open_.select(*names, "gm_n", begun.alias("gm_begun")), "cycles")
        done.append(rows)
        left = rows.where(F.element_at("gm_begun", -1) < horizon)
        if left.isEmpty():
            break
        open_ = left.select(*names, (F.col("gm_n") + ROUND).alias("gm_n"), F.element_at("gm_begun", -1).alias("gm_at"))
    all_ = done[0]
    for more in done[1:]:
        all_ = all_.union(more)
    each = all_.select(*names, "gm_n", F.posexplode(F.slice("gm_begun", 1, ROUND)).alias("gm_k", "at"))
    return each.where(F.col("at") < horizon).select(*names, (F.col("gm_n") + F.col("gm_k")).alias("n"), "at")


def equipment_events(units: DataFrame, by: list[str], horizon: float, seed: int, mttf: float = 1100.0, mttr: float = 37.3, fail_to_start: float = 0.0094, ready: float = 0.05, available: float = 0.995, accept: float = 0.01) -> DataFrame:
    """(by, t, d) of all units (by, unit): when one comes on (d = 1) and goes off (-1) before the horizon.

    A cycle is a start, a run unless the start fails, and a repair with its acceptance. The first start is at ``ready``, or
    after a repair for a unit that isn't available by then.
    """
    u = lambda *key: uniform(seed, *(F.col(k) for k in (*by, "unit")), *(k if isinstance(k, Column) else F.lit(k) for k in key))
    runs = lambda n: F.when(u(n, "start") >= fail_to_start, waiting(mttf, u(n, "run")))
    first = F.when(u("available") < available, F.lit(ready)).otherwise(F.greatest(F.lit(ready), waiting(mttr, u("first")) + accept))
    found = cycles(units.select(*by, "unit"), first, lambda n: F.coalesce(runs(n), F.lit(0.0)) + waiting(mttr, u(n, "repair")) + accept, horizon)
    ran = found.withColumn("ran", runs(F.col("n"))).where("ran is not null")
    ends = F.array(F.struct(F.col("at").alias("t"), F.lit(1).alias("d")), F.struct((F.col("at") + F.col("ran")).alias("t"), F.lit(-1).alias("d")))
    return ran.select(*by, F.explode(ends).alias("e")).select(*by, "e.t", "e.d").where(F.col("t") < horizon)


def ideal_events(units: DataFrame, by: list[str], horizon: float, ready: float = 0.05) -> DataFrame:
    """The same of units that never fail."""
    return units.select(*by, F.lit(ready).alias("t"), F.lit(1).alias("d")).where(F.col("t") < horizon)


def online_counts(events: DataFrame, by: list[str], horizon: float) -> DataFrame:
    """Elementary intervals with the number of units that are on."""
    ends = events.select(*by).distinct().select(*by, F.explode(F.array(F.lit(0.0), F.lit(horizon))).alias("t"), F.lit(0).alias("d"))
    steps = events.unionByName(ends).groupBy(*by, "t").agg(F.sum("d").alias("d"))
    order = W.partitionBy(*by).orderBy("t")
    made = steps.select(*by, F.col("t").alias("start_h"), F.lead("t").over(order).alias("end_h"), F.sum("d").over(order).alias("online"))
    return made.where("end_h is not null")


def up_spans(units: DataFrame, by: list[str], horizon: float, step: float, seed: int) -> DataFrame:
    """(by, unit, first, last): from which to which step a unit (by, unit, mttf, mttr, q) is up; up and down times alternate."""
    u = lambda key: uniform(seed, *(F.col(k) for k in (*by, "unit")), key)
    up = lambda n: (u(F.lit("up")) >= F.col("q")) == (n % 2 == 0)
    length = lambda n: waiting(F.when(up(n), F.col("mttf")).otherwise(F.col("mttr")), u(n))
    found = cycles(units.select(*by, "unit", "mttf", "mttr", "q"), F.lit(0.0), length, horizon).where(up(F.col("n")))
    last = F.ceil(F.least(F.col("at") + length(F.col("n")), F.lit(horizon)) / step) - 1
    return found.select(*by, "unit", F.ceil(F.col("at") / step).alias("first"), last.alias("last")).where("last >= first")


def outage_trace(units: DataFrame, by: list[str], horizon: float, step: float, seed: int) -> DataFrame:
    """(by, unit, index) of each step in which a unit is up."""
    spans = up_spans(units, by, horizon, step, seed)
    return spans.select(*by, "unit", F.explode(F.sequence("first", "last")).alias("index"))
