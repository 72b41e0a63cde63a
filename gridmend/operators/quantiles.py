"""Exact quantiles of groups of any size.

A mergeable sketch brackets the wanted ranks, rows inside and below the bracket are counted exactly, and the next pass looks only
at rows inside. Once few rows are left in a bracket they are numbered. No task holds the values of a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scan import matched
from .scratch import cut, erase

#: Rows in a bracket that one task numbers; points of a sketch, and its accuracy as a part of the rows.
FEW, POINTS, ACCURACY = 50_000, 256, 4_096


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str], few: int = FEW) -> DataFrame:
    """``by`` and one column for each of ``shares``, between two values by linear interpolation.

    Nulls and NaNs don't count; a group with nothing else has nulls. Without ``by`` there is one row. Equal values are no
    trouble: a bracket that has shrunk to one value is done. A pass leaves about 4 / POINTS of the rows in a bracket.
    """
    keys = [f"gm_by{i}" for i in range(len(by))] or ["gm_by0"]
    x = F.col(value).cast("double")
    rows = df.select(*((F.col(c).alias(k) for c, k in zip(by, keys, strict=True)) if by else (F.lit(0).alias("gm_by0"),)), F.when(F.isnan(x), None).otherwise(x).alias("gm_x"))
    sizes = cut(rows.groupBy(*keys).agg(F.count("gm_x").alias("gm_n")), "sizes")
    if not by and sizes.isEmpty():
        return df.sparkSession.createDataFrame([(None,) * len(shares)], ", ".join(f"{n} double" for n in names))
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)))).alias("q")
    exact = F.col("q.p") * (F.col("gm_n") - 1)
    ranks = sizes.where("gm_n > 0").select(*keys, asked, "gm_n").select(*keys, "gm_n", F.col("q.i").alias("gm_i"), exact.alias("gm_exact"))
    each = F.explode(F.array_distinct(F.array(F.floor("gm_exact"), F.ceil("gm_exact")))).alias("gm_rank")
    state = ranks.select(*keys, "gm_i", "gm_exact", each, F.lit(float("-inf")).alias("gm_lo"), F.lit(float("inf")).alias("gm_hi"), F.lit(0).cast("long").alias("gm_below"), F.col("gm_n").alias("gm_inside"))
    state = cut(state, "brackets")
    many = (F.col("gm_inside") > few) & (F.col("gm_lo") < F.col("gm_hi"))
    while not state.where(many).isEmpty():
        after = cut(state.where(~many).unionByName(_narrowed(rows, state.where(many), keys)), "brackets")
        erase(state)
        state = after
    inside = _in_brackets(rows, state.where("gm_lo < gm_hi"), keys)
    nth = F.row_number().over(W.partitionBy(*keys, "gm_i", "gm_rank").orderBy("gm_x")) - 1 + F.col("gm_below")
    picked = inside.withColumn("gm_nth", nth).where("gm_nth = gm_rank").select(*keys, "gm_i", "gm_exact", "gm_rank", "gm_x")
    picked = picked.unionByName(state.where("gm_lo = gm_hi").select(*keys, "gm_i", "gm_exact", "gm_rank", F.col("gm_lo").alias("gm_x")))
    share = F.first(F.col("gm_exact") - F.floor("gm_exact"))
    both = picked.groupBy(*keys, "gm_i").agg(F.min("gm_x").alias("a"), F.max("gm_x").alias("b"), share.alias("share"))
    found = both.select(*keys, "gm_i", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + F.col("share") * (F.col("b") - F.col("a"))).alias("x"))
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("gm_i") == i, F.col("x"))).alias(n) for i, n in enumerate(names)))
    out = matched(sizes.select(*keys), wide, keys, "left")
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), *names)


def _in_brackets(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    met = matched(rows.where("gm_x is not null"), state, keys)
    return met.where((F.col("gm_x") >= F.col("gm_lo")) & (F.col("gm_x") <= F.col("gm_hi")))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets by a sketch of the rows inside, each with exact counts.

    The sketch also gives a pivot near the rank. Rows are counted below it, at it and above it, so a bracket always loses the
    pivot's value, or has nothing but it; a sketch that is off costs a pass, and no rank.
    """
    grid = [i / POINTS for i in range(POINTS + 1)]
    ask = [*keys, "gm_i", "gm_rank"]
    sketch = _in_brackets(rows, state, keys).groupBy(*ask).agg(F.percentile_approx("gm_x", grid, ACCURACY).alias("points"))
    at = F.round((F.col("gm_rank") - F.col("gm_below")) / F.col("gm_inside") * POINTS).cast("int") + 1
    point = lambda i: F.element_at("points", F.least(F.lit(POINTS + 1), F.greatest(F.lit(1), i)))
    tried = matched(state, sketch, ask).select(*state.columns, point(at - 2).alias("lo"), point(at).alias("pivot"), point(at + 2).alias("hi"))
    tried = cut(tried, "tried")
    x, pivot = F.col("gm_x"), F.col("pivot")
    count = lambda which: F.count(F.when(which, 1))
    counts = _in_brackets(rows, tried, keys).groupBy(*ask).agg(
        count(x < F.col("lo")).alias("under"), count(x <= F.col("hi")).alias("upto"), count(x < pivot).alias("less"), count(x <= pivot).alias("most"),
        F.max(F.when(x < pivot, x)).alias("previous"), F.min(F.when(x > pivot, x)).alias("next"),
    )
    r = F.col("gm_rank") - F.col("gm_below")
    left, right = r < F.col("less"), r >= F.col("most")
    from_lo, to_hi = left & (r >= F.col("under")), right & (r < F.col("upto"))
    skipped = F.when(from_lo, F.col("under")).when(left, F.lit(0)).when(right, F.col("most")).otherwise(F.col("less"))
    ends = F.when(left, F.col("less")).when(to_hi, F.col("upto")).when(right, F.col("gm_inside")).otherwise(F.col("most"))
    return matched(tried, counts, ask).select(
        *ask,
        "gm_exact",
        F.when(from_lo, F.col("lo")).when(left, F.col("gm_lo")).when(right, F.col("next")).otherwise(pivot).alias("gm_lo"),
        F.when(left, F.col("previous")).when(to_hi, F.col("hi")).when(right, F.col("gm_hi")).otherwise(pivot).alias("gm_hi"),
        (F.col("gm_below") + skipped).alias("gm_below"),
        (ends - skipped).alias("gm_inside"),
    )
