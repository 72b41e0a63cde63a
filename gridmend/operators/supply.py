"""Supply adequacy: capacity outage tables, shortage expectations and allocation rules (Q01-Q07)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .relational import as_of


def expanded_fleet(groups: DataFrame) -> DataFrame:
    """One row for each unit of (unit_group, count, capacity_mw, forced_outage_rate)."""
    return groups.select("unit_group", "capacity_mw", F.col("forced_outage_rate").alias("q"), F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("unit"))


def availability_mismatch(groups: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """Groups whose outage rate isn't mttr / (mttf + mttr)."""
    return groups.where(F.abs(F.col("forced_outage_rate") - F.col("mttr_hours") / (F.col("mttf_hours") + F.col("mttr_hours"))) > tolerance)


def convolve(sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Probabilities of each whole outage MW of independent units."""
    pmf = np.ones(1)
    for size, q in zip(sizes.astype(int), rates, strict=True):
        new = np.zeros(len(pmf) + size)
        new[: len(pmf)] += (1 - q) * pmf
        new[size:] += q * pmf
        pmf = new
    return pmf


def capacity_table(units: DataFrame, by: list[str]) -> DataFrame:
    """(by, capacity_mw, p): the exact distribution of available capacity of each fleet (by, capacity_mw, q).

    Units of equal size and rate are counted first, so that a group's rows are its different units.
    """
    kinds = units.groupBy(*by, "capacity_mw", "q").agg(F.count("*").alias("n"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*by).schema)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["capacity_mw", "q"])
        pmf = convolve(np.repeat(pdf.capacity_mw.to_numpy(), pdf.n), np.repeat(pdf.q.to_numpy(), pdf.n))
        out = pd.DataFrame({"capacity_mw": np.arange(len(pmf) - 1, -1, -1), "p": pmf})
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "capacity_mw", "p"]]

    return kinds.groupBy(*by).applyInPandas(fold, f"{fields}, capacity_mw long, p double").where("p > 0")


def prefix_moments(table: DataFrame, by: list[str]) -> DataFrame:
    """The table with the probability and first moment of all capacities up to each."""
    upto = W.partitionBy(*by).orderBy("capacity_mw").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table.withColumns({"p_upto": F.sum("p").over(upto), "m_upto": F.sum(F.col("p") * F.col("capacity_mw")).over(upto)})


def shortage(table: DataFrame, demands: DataFrame, by: list[str]) -> DataFrame:
    """For each demand of (by, demand): the expected shortage and its probability, capacities strictly below it.

    D F(D) - M(D) from the sums up to the last capacity below D, which one merged pass finds.
    """
    steps = prefix_moments(table, by).withColumn("capacity", F.col("capacity_mw").cast("double"))
    met = as_of(demands.select(*by, "demand"), steps, by, "demand", "capacity", ["p_upto", "m_upto"], strict=True, clamp=False)
    p, m = (F.coalesce(k, F.lit(0.0)) for k in ("p_upto", "m_upto"))
    return met.select(*by, "demand", (F.col("demand") * p - m).alias("expected_shortage"), p.alias("p_shortage"))


def allocate(capacity: Column, total: Column, critical: Column, dc: Column, rule: str = "conventional") -> tuple[Column, Column, Column]:
    """(community loss, critical loss, data-centre loss) in MW under one of three rules."""
    zero = F.lit(0.0)
    critical_loss = F.greatest(zero, critical - capacity)
    left = F.greatest(zero, capacity - critical)
    ordinary = total - critical
    if rule == "conventional":  # what remains is shared in proportion
        eligible = ordinary + dc
        short = F.greatest(zero, eligible - left)
        share = F.when(eligible > 0, ordinary / eligible).otherwise(0.0)
        return critical_loss + short * share, critical_loss, short * (1 - share)
    if rule == "dc_first":  # the data centre is curtailed before the community
        short = F.greatest(zero, ordinary + dc - left)
        dc_loss = F.least(dc, short)
        return critical_loss + short - dc_loss, critical_loss, dc_loss
    if rule == "dc_priority_upper":  # and here after it
        short = F.greatest(zero, ordinary + dc - left)
        own = F.least(ordinary, short)
        return critical_loss + own, critical_loss, short - own
    raise ValueError(f"unknown rule {rule}")
