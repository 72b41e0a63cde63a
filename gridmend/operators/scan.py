"""Scans over ordered groups of any size: no task holds a whole group.

Rows are sorted once into ranges over all groups. A group may lie in many ranges, and what a range adds to it is one
row; these rows are summed or composed, and each range goes on from what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import cut, erase

#: Bits of a place that count the rows of a range.
_ROW_BITS = 33
#: Rows of a block of an affine scan, rows of a block of blocks; above it are whole groups, with a row for each of these.
SPANS = (256, 1 << 20)


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``rows`` with ``gm_at``, which grows in the order of groups and of ``order``; written once. ``order`` should tell all
    rows apart, else those that tie come in any order."""
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return cut(ranged.withColumn("gm_at", F.monotonically_increasing_id()), "placed")


def sums_before(rows: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` of placed() with, for each of ``values``, the sum over the rows of the group before this one."""
    part = F.shiftright("gm_at", _ROW_BITS)
    x = rows.withColumn("gm_part", part).withColumns({f"gm_{k}": c for k, c in values.items()})
    totals = x.groupBy(*by, "gm_part").agg(*(F.sum(f"gm_{k}").alias(f"gm_{k}") for k in values))
    ahead = W.partitionBy(*by).orderBy("gm_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of the group
    starts = totals.select(*by, "gm_part", *(F.coalesce(F.sum(f"gm_{k}").over(ahead), F.lit(0)).alias(f"gm_start_{k}") for k in values))
    inside = W.partitionBy(*by, "gm_part").orderBy("gm_at").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({k: F.coalesce(F.sum(f"gm_{k}").over(inside), F.lit(0)) for k in values})
    met = matched(x, starts, [*by, "gm_part"])
    return met.select(*rows.columns, *((F.col(k) + F.col(f"gm_start_{k}")).alias(k) for k in values))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null, with the columns of ``right`` that aren't keys."""
    other = right.select(*(F.col(k).alias(f"gm_key{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition &= F.col(k).eqNullSafe(F.col(f"gm_key{i}"))
    return left.join(other, condition, how).drop(*(f"gm_key{i}" for i in range(len(keys))))


def waterfall(needs: DataFrame, by: Sequence[str], need: str, cap: Column, order: Sequence[Column | str], out: str = "given") -> DataFrame:
    """``needs`` with min(need, what is left of the cap), in order. ``cap`` is the same for all rows of a group; null needs get
    nothing and take nothing."""
    columns = needs.columns
    x = sums_before(placed(needs.withColumn("gm_cap", cap), by, order), by, {"gm_before": F.coalesce(F.col(need), F.lit(0.0))})
    given = F.greatest(F.lit(0.0), F.least(F.coalesce(F.col(need), F.lit(0.0)), F.col("gm_cap") - F.col("gm_before")))
    return x.select(*columns, given.alias(out))


def take_under_cap(items: DataFrame, by: Sequence[str], size: str, cap: float, order: Sequence[Column | str], least: int = 0) -> DataFrame:
    """Items that fit under the cap in order, oversize ones skipped; the first ``least`` are taken anyway. Sizes are 0 or more;
    items without one are never taken.

    In a round each group takes items as long as they fit. The one that doesn't, and all others above the room that is left,
    will never fit, so the next round looks at later and smaller ones only. A round is a sum over ranges; all groups share it.
    """
    columns = items.columns
    rows = sums_before(placed(items.where(F.col(size).isNotNull()), by, order), by, {"gm_rank": F.lit(1).cast("long")})
    first, left = rows.where(F.col("gm_rank") < least), rows.where(F.col("gm_rank") >= least)
    used = first.groupBy(*by).agg(F.sum(size).alias("gm_used"))
    left = matched(left, used, by, "left").withColumn("gm_room", F.lit(float(cap)) - F.coalesce("gm_used", F.lit(0.0))).drop("gm_used")
    taken = [first.select(*columns)]
    left = cut(left.where(F.col(size) <= F.col("gm_room")), "candidates")
    while not left.isEmpty():
        summed = sums_before(left, by, {"gm_before": F.col(size)})
        ends = summed.where(F.col("gm_before") + F.col(size) > F.col("gm_room")).groupBy(*by).agg(F.min("gm_at").alias("gm_end"))
        round_ = cut(matched(summed, ends, by, "left"), "round")
        fits = F.col("gm_end").isNull() | (F.col("gm_at") < F.col("gm_end"))
        taken.append(round_.where(fits).select(*columns))
        used = round_.where(fits).groupBy(*by).agg(F.sum(size).alias("gm_used"))
        rest = matched(round_.where(F.col("gm_at") > F.col("gm_end")), used, by, "left").withColumn("gm_room", F.col("gm_room") - F.coalesce("gm_used", F.lit(0.0)))
        after = cut(rest.where(F.col(size) <= F.col("gm_room")).select(*left.columns), "candidates")
        erase(left)
        left = after
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def affine_before(rows: DataFrame, by: Sequence[str], a: Column, b: Column, start: float = 0.0, out: str = "before", spans: Sequence[int] = SPANS) -> DataFrame:
    """``rows`` of placed() with the state before each row, where a row makes a x state + b of it.

    Such maps compose to one of their kind. Blocks of rows become one map each, and blocks of blocks; with the state that enters a
    block its rows are followed one by one. All of it is column expressions over arrays of bounded length.
    """
    items = rows.select(*by, F.col("gm_at").alias("at"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    states = _entered(items, list(by), start, list(spans)).select(F.col("at").alias("gm_key_at"), F.col("state").alias(out))
    return rows.join(states, F.col("gm_at") == F.col("gm_key_at")).drop("gm_key_at")


def _entered(items: DataFrame, by: list[str], start: float, spans: list[int]) -> DataFrame:
    """(by, at, state): the state before each of ``items`` (by, at, a, b)."""
    group = [*by, "block"] if spans else by
    if spans:
        row = F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        items = items.withColumn("block", F.col("at") - row % spans[0])
    packed = items.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b"))).alias("xs"))
    packed = cut(
        packed.withColumns({
            "times": F.aggregate("xs", F.lit(1.0), lambda s, x: s * x["a"]),
            "plus": F.aggregate("xs", F.lit(0.0), lambda s, x: x["a"] * s + x["b"]),
        }),
        "blocks",
    )
    if spans:
        blocks = packed.select(*by, F.col("block").alias("at"), F.col("times").alias("a"), F.col("plus").alias("b"))
        # a block at the edge of two groups belongs to each, so its place alone doesn't tell
        known = _entered(blocks, by, start, spans[1:])
        packed = matched(packed, known.select(*by, F.col("at").alias("block"), F.col("state").alias("enters")), group)
    else:
        packed = packed.withColumn("enters", F.lit(start))
    followed = F.aggregate(
        "xs",
        F.struct(F.col("enters").alias("now"), F.array().cast("array<struct<at:bigint,state:double>>").alias("out")),
        lambda s, x: F.struct((x["a"] * s["now"] + x["b"]).alias("now"), F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), s["now"].alias("state")))).alias("out")),
        lambda s: s["out"],
    )
    return packed.select(*by, F.explode(followed).alias("x")).select(*by, "x.at", "x.state")

