"""Contracts as queries that return violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .relational import contiguity_breaks, duplicates, key_differences
from .scratch import small


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def broken(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys, rule) for each row and rule that doesn't hold; null counts as not holding. One pass for all rules."""
    failed = F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()))
    return df.select(*keys, F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("rule"))


def finite(*columns: str) -> dict[str, Column]:
    inf = float("inf")
    return {f"{c} is finite": F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf) for c in columns}


def step_violations(episodes: DataFrame, steps: DataFrame, keys: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """What episodes (keys, n_steps, ens) and their steps (keys, step_index, start, end, step_ens) disagree about."""
    keys = list(keys)
    own = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.min("step_index").alias("low"), F.max("step_index").alias("high"), F.count_distinct("step_index").alias("different"), F.sum("step_ens").alias("total"))
    met = episodes.join(own, keys, "full_outer")
    rules = {
        "episode has steps": F.col("n").isNotNull(),
        "steps have an episode": F.col("n_steps").isNotNull(),
        "steps are numbered from 0": F.col("n").isNull() | ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("different") == F.col("n"))),
        "number of steps": F.col("n").isNull() | F.col("n_steps").isNull() | (F.col("n") == F.col("n_steps")),
        "energy adds up": F.col("n").isNull() | F.col("n_steps").isNull() | (F.abs(F.col("total") - F.col("ens")) <= tolerance * F.greatest(F.lit(1.0), F.abs("ens"))),
    }
    gaps = contiguity_breaks(steps, keys, "step_index", "start", "end").select(*keys, F.lit("steps are contiguous").alias("rule"))
    return broken(met, rules, keys).unionByName(gaps.distinct())


def method_gaps(runs: DataFrame, keys: Sequence[str], method: str, base: str) -> DataFrame:
    """(method, keys, side): cases that a method lacks or has beyond the baseline's."""
    cases = runs.select(method, *keys).distinct()
    want = cases.where(F.col(method) == base).select(*keys).crossJoin(small(cases.select(method).distinct().where(F.col(method) != base)))
    return key_differences(cases.where(F.col(method) != base), want, [method, *keys])


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return duplicates(df, keys)


def case_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that aren't nodes, and ids that repeat."""
    ends = edges.select("edge_id", F.explode(F.array("a", "b")).alias("node"))
    lost = ends.join(nodes.select("node").distinct(), "node", "left_anti").select(F.col("edge_id").cast("string").alias("id"), F.concat(F.lit("unknown end "), F.col("node").cast("string")).alias("rule"))
    twice = duplicates(edges, ["edge_id"]).select(F.col("edge_id").cast("string").alias("id"), F.lit("edge id repeats").alias("rule"))
    return lost.unionByName(twice)


def sequence_violations(orders: DataFrame, damaged: DataFrame, case: str) -> DataFrame:
    """Cases whose repair order (case, place, edge_id) isn't a permutation of the damage (case, edge_id)."""
    extra = key_differences(orders, damaged, [case, "edge_id"]).select(case, F.concat(F.lit("only in "), F.when(F.col("side") == "left", "order").otherwise("damage")).alias("rule"))
    places = orders.groupBy(case).agg(F.count("*").alias("n"), F.count_distinct("edge_id").alias("d"), F.max("place").alias("high"))
    bad = places.where("d <> n or high <> n - 1").select(case, F.lit("places or edges repeat").alias("rule"))
    return extra.unionByName(bad).distinct()


def balance_violations(ledger: DataFrame, keys: Sequence[str], balances: dict[str, Sequence[tuple[str, int]]], tolerance: float = 1e-7) -> DataFrame:
    """Rows in which the signed terms of a balance don't cancel."""
    rules = {k: F.abs(reduce(lambda a, b: a + b, (F.col(c) * sign for c, sign in terms))) <= tolerance for k, terms in balances.items()}
    return broken(ledger, rules, keys)


def paired_violations(runs: DataFrame, keys: Sequence[str], treatment: str, off: str) -> DataFrame:
    """With support, critical energy isn't worse, and what is avoided is what was exported."""
    base = runs.where(F.col(treatment) == off).select(*keys, F.col("ens").alias("ens0"), F.col("critical_ens").alias("critical0"), F.col("order_hash").alias("hash0"))
    met = runs.where(F.col(treatment) != off).join(base, list(keys), "left")
    rules = {
        "has a baseline": F.col("ens0").isNotNull(),
        "same repairs": F.col("order_hash") == F.col("hash0"),
        "avoided energy is exported energy": F.abs(F.col("ens0") - F.col("ens") - F.col("exported")) <= 1e-6,
        "critical energy isn't worse": F.col("critical_ens") <= F.col("critical0") + 1e-9,
    }
    return broken(met, rules, [*keys, treatment])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
