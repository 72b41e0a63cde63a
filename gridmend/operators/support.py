"""Support with bounded power and energy, and the settings of sites and studies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Resource:
    """``scale`` times the zone's power cap; ``hours`` of it in store, or no limit."""

    name: str
    scale: float = 1.0
    hours: float | None = None

    def energy(self, cap_mw: Column) -> Column:
        return cap_mw * self.scale * self.hours if self.hours is not None else F.lit(float("inf"))


def finite_support(steps: DataFrame, by: Sequence[str], order: str, potential: str, energy: Column, end: str) -> DataFrame:
    """Steps with used, fraction, remaining and depleted_h: what each step's potential energy can draw from a store.

    The store only falls, so what is left is the store less the running sum: a window, no loop. A step's fraction
    holds for all of it; a store that ends within a step is depleted at the step's end.
    """
    w = W.partitionBy(*by).orderBy(order)
    before = F.coalesce(F.sum(potential).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.greatest(F.lit(0.0), energy - before)
    used = F.least(F.col(potential), left)
    out = steps.withColumn("used", used).withColumn("fraction", F.when(F.col(potential) > 0, F.col("used") / F.col(potential)).otherwise(0.0))
    out = out.withColumn("remaining", F.greatest(F.lit(0.0), energy - before - F.col(potential)))
    depleted = F.min(F.when(F.col("remaining") <= 1e-9, F.col(end))).over(W.partitionBy(*by))
    return out.withColumn("depleted_h", depleted)


def resource_benefit(runs: DataFrame, keys: Sequence[str], resource: str, base: str, metrics: Sequence[str]) -> DataFrame:
    """Percent reductions of each resource against the run without any, by key; a base that isn't positive gives null."""
    off = runs.where(F.col(resource) == base).select(*keys, *(F.col(m).alias(f"{m}_base") for m in metrics))
    met = runs.where(F.col(resource) != base).join(off, list(keys))
    return met.select(*keys, resource, *((100 * (F.col(f"{m}_base") - F.col(m)) / F.when(F.col(f"{m}_base") > 0, F.col(f"{m}_base"))).alias(f"{m}_reduction_pct") for m in metrics))


def validate_settings(given: dict, required: dict[str, tuple[float, float]], name: str = "settings") -> dict:
    """``given`` if it has exactly the required keys, all numbers within their ranges; else ValueError names all faults."""
    faults = [f"{k} is missing" for k in required if k not in given] + [f"{k} isn't known" for k in given if k not in required]
    for k, (low, high) in required.items():
        if k in given:
            x = given[k]
            if isinstance(x, bool) or not isinstance(x, (int, float)) or x != x or not low <= x <= high:
                faults.append(f"{k} must be a number from {low:g} to {high:g}")
    if faults:
        raise ValueError(f"{name}: " + "; ".join(faults))
    return given


def facility_size(it_mw: Column, pue: float, unit_mw: float, spare_units: int) -> dict[str, Column]:
    """Sizes of a site from its IT power."""
    total = it_mw * pue
    units = F.ceil(total / unit_mw) + spare_units
    return {"facility_mw": total, "cooling_mw": total - it_mw, "backup_units": units, "backup_mw": units * unit_mw}


def null_contract(df: DataFrame, value: str, state: str, absent: str, keys: Sequence[str]) -> DataFrame:
    """Rows where ``value`` is null though ``state`` doesn't say so, or the other way round."""
    return df.where(F.col(value).isNull() != (F.col(state) == absent)).select(*keys, F.when(F.col(value).isNull(), "value is missing").otherwise("value shouldn't be there").alias("rule"))


def extent(points: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Centroid and bounding box of each group of points."""
    return points.groupBy(*by).agg(F.avg(x).alias("centre_x"), F.avg(y).alias("centre_y"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))
