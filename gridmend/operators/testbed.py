"""Jobs that assemble a study case: extracts, load series and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import components
from .scan import take_under_cap
from .scratch import small


def nearest_peers(nodes: DataFrame, centres: DataFrame, by: str, distance: Column, id_: str, k: int) -> DataFrame:
    """(by, id, place): the ``k`` nearest nodes of each of a few centres, the least id among equals."""
    met = nodes.crossJoin(small(centres))
    place = F.row_number().over(W.partitionBy(by).orderBy("gm_d", id_))
    return met.withColumn("gm_d", distance).withColumn("place", place).where(F.col("place") <= k).select(by, id_, "place", F.col("gm_d").alias("distance"))


def extract(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends in ``kept`` (node), and interface edges with one end in it."""
    ends = edges.join(kept.select(F.col("node").alias("a"), F.lit(True).alias("in_a")), "a", "left").join(kept.select(F.col("node").alias("b"), F.lit(True).alias("in_b")), "b", "left")
    n = F.coalesce("in_a", F.lit(False)).cast("int") + F.coalesce("in_b", F.lit(False)).cast("int")
    return tuple(ends.where(n == k).select("edge_id", "a", "b") for k in (2, 1))


def load_series(loads: DataFrame, profiles: DataFrame) -> DataFrame:
    """(load_id, t, kw) of loads (load_id, profile_id, kw) and long profiles (profile_id, t, multiplier)."""
    return loads.join(profiles, "profile_id").select("load_id", "t", (F.col("kw") * F.col("multiplier")).alias("kw"))


def conservation(series: DataFrame, loads: DataFrame, profiles: DataFrame) -> DataFrame:
    """(t, kw, want): by hour, the sum of the loads' series and what the profiles' totals ask for; both are summed before
    they meet."""
    own = series.groupBy("t").agg(F.sum("kw").alias("kw"))
    by_profile = loads.groupBy("profile_id").agg(F.sum("kw").alias("total"))
    want = profiles.join(by_profile, "profile_id").groupBy("t").agg(F.sum(F.col("total") * F.col("multiplier")).alias("want"))
    return own.join(want, "t", "full_outer")


def smoke_faults(nodes: DataFrame, edges: DataFrame, loads: DataFrame) -> DataFrame:
    """(rule, n) of what is wrong with a case: islands, loads without a node, powers that aren't positive."""
    islands = components(nodes, edges).select("component").distinct().agg(F.count("*").alias("n")).select(F.lit("case isn't connected").alias("rule"), (F.col("n") - 1).alias("n"))
    lost = loads.join(nodes.select("node").distinct(), "node", "left_anti").agg(F.count("*").alias("n")).select(F.lit("load has no node").alias("rule"), "n")
    bad = loads.where(~F.coalesce(F.col("kw") > 0, F.lit(False))).agg(F.count("*").alias("n")).select(F.lit("power isn't positive").alias("rule"), "n")
    return islands.unionByName(lost).unionByName(bad).where("n > 0")


def stripped(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    """Rows that an overlay doesn't own, narrowed to the case's columns."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False))).select(*columns)


def anchor_zones(loads: DataFrame, by: str, cap_kw: float, support_mw: float, hours: float) -> DataFrame:
    """A zone for each site ``by``: the loads that its support stands for, taken in the order of criticality, value, size and id as long
    as they fit under ``cap_kw``; their power, its share of the site's load, and the power and energy of the support.

    Sites whose first loads are all too large have no zone. The ids of a zone, which the cap bounds, are a JSON array.
    """
    order = [F.desc("is_critical"), F.desc("voll"), F.desc("kw"), F.col("load_id")]
    taken = take_under_cap(loads.select(by, "load_id", "kw", "is_critical", "voll"), [by], "kw", cap_kw, order)
    zones = taken.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list("load_id"))).alias("anchor_load_ids"), (F.sum("kw") / 1000).alias("anchor_load_mw"))
    whole = loads.groupBy(by).agg((F.sum("kw") / 1000).alias("gm_mw"))
    support = F.least(F.lit(support_mw), F.col("anchor_load_mw"))
    return zones.join(whole, by).select(F.concat(F.lit("zone_"), F.col(by).cast("string")).alias("anchor_zone_id"), by, "anchor_load_ids", "anchor_load_mw", (F.col("anchor_load_mw") / F.col("gm_mw")).alias("anchor_load_share"), support.alias("max_support_mw"), (support * hours).alias("energy_budget_mwh"))


def selected_sites(candidates: DataFrame, area: str, score: str, id_: str, n: int, least: float) -> DataFrame:
    """(area, place, id, score): the ``n`` best candidates of each area that score ``least`` or more; the least id among equals."""
    place = F.row_number().over(W.partitionBy(area).orderBy(F.desc(score), id_))
    return candidates.where(F.col(score) >= least).withColumn("place", place).where(F.col("place") <= n).select(area, "place", id_, score)
