"""Paired comparisons, bootstraps and curves (ST01-ST07, A04-A11)."""

from __future__ import annotations

from math import exp, factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from .quantiles import quantiles
from .relational import as_of
from .scan import matched
from .scratch import cut

TIE = 1e-6


def comparison(pairs: DataFrame, by: list[str], value: str, base: str) -> DataFrame:
    """Mean and median reduction, and shares of wins, ties and losses at a tolerance; smaller is better."""
    d = F.col(base) - F.col(value)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(d).alias("mean_reduction"),
        F.percentile(d, F.lit(0.5)).alias("median_reduction"),
        share(d > TIE).alias("win_rate"),
        share(F.abs(d) <= TIE).alias("tie_rate"),
        share(d < -TIE).alias("loss_rate"),
    )


def reductions(pairs: DataFrame, by: list[str], value: str, base: str) -> DataFrame:
    """Both the ratio of means and the mean of ratios, in percent; bases that aren't positive have no ratio."""
    each = F.when(F.col(base) > 0, (F.col(base) - F.col(value)) / F.col(base))
    return pairs.groupBy(*by).agg(
        (100 * (F.avg(base) - F.avg(value)) / F.when(F.avg(base) > 0, F.avg(base))).alias("ratio_of_means_pct"),
        (100 * F.avg(each)).alias("mean_of_ratios_pct"),
    )


def normal_interval(df: DataFrame, by: list[str], value: str, fraction: bool = False) -> DataFrame:
    """Mean with 1.96 standard errors on each side, within [0, 1] for fractions; one row has no interval."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    low, high = F.avg(value) - half, F.avg(value) + half
    if fraction:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), low.alias("low"), high.alias("high"))


def bootstrap_of(values: np.ndarray, draws: int = 2000, seed: int = 1, statistic=np.mean) -> tuple[float, float]:
    """95 percent percentile interval of a statistic of a small sample, by resampling; nan without finite values."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return np.nan, np.nan
    rng = np.random.default_rng(seed)
    low, high = np.quantile([statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(draws)], [0.025, 0.975])
    return float(low), float(high)


def poisson_steps() -> list[float]:
    """The cumulative probabilities of 0 to 7 for a mean of 1."""
    return np.cumsum([exp(-1.0) / factorial(k) for k in range(8)]).tolist()


def poisson_bootstrap(df: DataFrame, by: list[str], value: str, key: Column, draws: int = 200, seed: int = 1) -> DataFrame:
    """The same interval for groups of any size: each row counts a Poisson(1) number of times in each draw.

    Null values count for nothing, and neither do draws without any row. The counts come from a hash of the row's key and the draw, so rows may be anywhere, and sums are combined before
    the shuffle.
    """
    steps = poisson_steps()
    u = uniform(seed, key, F.col("draw"))
    count = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    long = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("times", count)
    means = long.where(F.col(value).isNotNull()).groupBy(*by, "draw").agg((F.sum(F.col(value) * F.col("times")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def hourly_curves(steps: DataFrame, by: list[str], case: str, start: str, value: str, horizon: int, grid: int = 1) -> DataFrame:
    """Mean and quartiles over cases on an even grid of hours; each case keeps its last step's value."""
    points = steps.select(*by, case).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(horizon), F.lit(grid))))
    met = as_of(points, steps, [*by, case], "hour", start, [value])
    met = cut(met, "curves")
    keys = [*by, "hour"]
    means = met.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return matched(means, quantiles(met, keys, value, [0.25, 0.75], ["q25", "q75"]), keys)
