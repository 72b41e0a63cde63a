"""Samples that keys decide (ST06, H02)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.draws import uniform


def bottom_k(df: DataFrame, by: Sequence[str], ids: Sequence[str], k: int, seed: int) -> DataFrame:
    """At most ``k`` rows of each group, those with the least draws of their ``ids``; equal draws go by ids, and null ids draw too.

    Samples of parts merge to that of the whole, and tasks thin their groups to ``k`` rows before the shuffle (Spark limits a window of
    ranks ahead of its exchange). So a group moves k rows for each task, whatever it holds.
    """
    draw = uniform(seed, *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ids))
    place = F.row_number().over(W.partitionBy(*by).orderBy("gm_draw", *ids))
    return df.withColumn("gm_draw", draw).withColumn("gm_place", place).where(F.col("gm_place") <= k).drop("gm_draw", "gm_place")
