"""Joins with contracts, interval algebra, allocation and reshaping (J, A, W, U groups)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``copies``."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def conflicting(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ elsewhere, with the number of ``rows``; null values count as values.

    Rows are compared by two 64-bit hashes, whose least and largest are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    marks = [F.xxhash64(F.lit(salt), *(x for c in rest for x in (F.col(c).isNull(), F.col(c)))) for salt in (1, 2)]
    spans = [f(m).alias(f"gm_{i}{k}") for i, m in enumerate(marks) for k, f in (("low", F.min), ("high", F.max))]
    found = df.groupBy(*keys).agg(F.count("*").alias("rows"), *spans)
    return found.where("gm_0low <> gm_0high or gm_1low <> gm_1high").select(*keys, "rows")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Sequence[str], suffix: str = "_base") -> DataFrame:
    """``left`` with the metrics of the row of ``right`` with the same keys; ``right`` must be unique on them."""
    other = right.select(*keys, *(F.col(m).alias(m + suffix) for m in metrics))
    return left.join(other, list(keys))


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with ``side``."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def as_of(points: DataFrame, steps: DataFrame, by: Sequence[str], time: str, start: str, values: Sequence[str], strict: bool = False, clamp: bool = True) -> DataFrame:
    """Each point with the values of the last step that starts at or before it; ``strict``: before it.

    Points ahead of all steps get the first step's values, or nulls without ``clamp``. Both sides are merged in one
    sorted pass for each group: no range join and no pair of point and step is made.
    """
    fields = F.struct(F.col(start).alias("s"), *(F.col(v) for v in values))
    marked = steps.select(*by, F.col(start).alias("gm_t"), fields.alias("gm_v"), F.lit(2 if strict else 0).alias("gm_kind"), F.lit(None).cast(points.schema[time].dataType).alias("gm_p"))
    asked = points.select(*by, F.col(time).cast(steps.schema[start].dataType).alias("gm_t"), F.lit(None).cast(marked.schema["gm_v"].dataType).alias("gm_v"), F.lit(1).alias("gm_kind"), F.col(time).alias("gm_p"))
    order = W.partitionBy(*by).orderBy("gm_t", "gm_kind")
    found = F.last("gm_v", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    if clamp:
        found = F.coalesce(found, F.first("gm_v", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    met = marked.unionByName(asked).withColumn("gm_x", found).where("gm_kind = 1")
    if clamp:
        met = met.where("gm_x is not null")
    return met.select(*by, F.col("gm_p").alias(time), *(F.col(f"gm_x.{v}").alias(v) for v in values))


def refined(intervals: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The elementary intervals between all breakpoints of a group, with how many of its intervals cover each."""
    points = intervals.select(*by, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(*by, F.col(end).alias("t"), F.lit(-1).alias("d")))
    steps = points.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    order = W.partitionBy(*by).orderBy("t")
    cut = steps.select(*by, F.col("t").alias("start"), F.lead("t").over(order).alias("end"), F.sum("d").over(order).alias("online"))
    return cut.where("end is not null")


def union_time(intervals: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """How long any interval of the group lasts, overlaps counted once, and how long all do together."""
    cut = refined(intervals, by, start, end)
    length = F.col("end") - F.col("start")
    return cut.groupBy(*by).agg(F.sum(F.when(F.col("online") > 0, length).otherwise(0)).alias("union_time"), F.sum(F.col("online") * length).alias("total_time"))


def top_share(df: DataFrame, by: Sequence[str], share: float, order: Sequence[Column]) -> DataFrame:
    """The first ceil(share x rows) rows of each group, one at least."""
    ranked = df.withColumn("gm_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).withColumn("gm_n", F.count("*").over(W.partitionBy(*by)))
    return ranked.where(F.col("gm_rank") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("gm_n")))).drop("gm_rank", "gm_n")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.withColumn("gm_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("gm_rank") <= n).drop("gm_rank")


def smoothed(df: DataFrame, by: Sequence[str], order: str, value: str, reach: int = 3, out: str = "smooth") -> DataFrame:
    """Centred mean over 2 x reach + 1 rows, clipped to [0, 1]; the first and last ``reach`` rows stay as they are."""
    w = W.partitionBy(*by)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    mean = F.avg(value).over(w.orderBy(order).rowsBetween(-reach, reach))
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((i <= reach) | (i > n - reach), F.col(value)).otherwise(mean))))


def contiguity_breaks(steps: DataFrame, by: Sequence[str], order: str, start: str, end: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows that don't start where the row before ended."""
    before = F.lag(end).over(W.partitionBy(*by).orderBy(order))
    return steps.withColumn("previous_end", before).where(F.abs(F.col(start) - F.col("previous_end")) > tolerance)


def first_passage(steps: DataFrame, by: Sequence[str], start: str, fraction: str, levels: dict[str, float], tolerance: float = 1e-10) -> DataFrame:
    """When each level of service is first reached; null if never."""
    return steps.groupBy(*by).agg(*(F.min(F.when(F.col(fraction) >= p - tolerance, F.col(start))).alias(k) for k, p in levels.items()))


def ecdf(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str] = ()) -> DataFrame:
    """rank / n with a step for every row, ties included."""
    w = W.partitionBy(*by)
    return df.withColumn("ecdf", F.row_number().over(w.orderBy(value, *tie)) / F.count("*").over(w))


def contracted(edges: DataFrame, ends: Sequence[str] = ("from_node", "to_node"), kind: str = "edge_type") -> DataFrame:
    """Parallel edges as one: summed lengths, largest flags, most frequent feeder (the least of equals), members."""
    pair = edges.withColumns({"a": F.least(*ends), "b": F.greatest(*ends)})
    keys = ["a", "b", kind]
    votes = pair.groupBy(*keys, "feeder").agg(F.count("*").alias("n"))
    feeder = votes.groupBy(*keys).agg(F.min_by("feeder", F.struct((-F.col("n")).alias("n"), "feeder")).alias("feeder"))
    rolled = pair.groupBy(*keys).agg(
        F.sum("length").alias("length"),
        F.max("flag").alias("flag"),
        F.bool_or("is_open").alias("is_open"),
        F.to_json(F.array_sort(F.collect_set("edge_id"))).alias("members"),
    )
    return rolled.join(feeder, keys)


def melted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def pivoted(df: DataFrame, keys: Sequence[str], name: str, values: Sequence, value: str) -> DataFrame:
    return df.groupBy(*keys).pivot(name, list(values)).agg(F.sum(value))


def profile_combination(parts: DataFrame, by: Sequence[str], weight: str, profile: str) -> DataFrame:
    """The weighted sum of arrays, element by element, with its largest and mean element.

    Elements are summed as rows, so partial sums are combined before the shuffle whatever the group's size.
    """
    long = parts.select(*by, weight, F.posexplode(profile).alias("i", "x")).groupBy(*by, "i").agg(F.sum(F.col(weight) * F.col("x")).alias("x"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("profile"), F.max("x").alias("peak"), F.avg("x").alias("mean"))
