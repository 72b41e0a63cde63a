"""Bootstraps in which every draw has exactly as many rows as its group (ST01).

A draw deals n rows with replacement. How many of them fall to a block of rows is found by going down a tree over the blocks: at each
node what has come so far is split in two by a binomial number, whose randomness a key of group, draw and node decides. So any
task finds the count of its block alone, the counts of all blocks add up to n, and within a block the rows are drawn there.
Values never leave their block; what is shuffled is one sum for each block and draw, combined before it moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

#: Values of a block.
BLOCK = 4_096


def _random(seed: int, group: int, draw: int, node: int) -> np.random.Generator:
    key = np.array([seed, group], np.int64).view(np.uint64)
    return np.random.Generator(np.random.Philox(key=key, counter=np.array([0, 0, draw, node], np.uint64)))


def dealt(n: int, block: int, size: int, seed: int, group: int, draw: int) -> int:
    """How many of a draw's ``n`` rows come from block number ``block`` of ``size`` rows."""
    low, high, count, node = 0, -(-n // size), n, 1
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = middle * size - low * size, min(n, high * size) - low * size
        share = _random(seed, group, draw, node).binomial(count, left / whole)
        low, high, count, node = (low, middle, share, 2 * node) if block < middle else (middle, high, count - share, 2 * node + 1)
    return int(count)


def block_sums(values: np.ndarray, n: int, block: int, size: int, seed: int, group: int, draws: int) -> np.ndarray:
    """For each draw, the sum of what it takes from a block."""
    out = np.zeros(draws)
    for draw in range(draws):
        count = dealt(n, block, size, seed, group, draw)
        out[draw] = values[_random(seed, group, draw, (1 << 62) + block).integers(0, len(values), count)].sum()
    return out


def draw_means(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], draws: int = 2_000, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(by, draw, mean): the mean of each of ``draws`` draws of as many rows as the group has values.

    Nulls and NaNs are no values, and a group with nothing else has no draws. Rows are numbered by ``order``, which should tell
    them apart: the same numbers are then drawn wherever rows are. A group of any size is spread over its blocks.
    """
    x = F.col(value).cast("double")
    rows = df.select(*by, *(c for c in order if c not in by), x.alias("gm_x")).where("gm_x is not null and not isnan(gm_x)")
    numbered = scan.sums_before(scan.placed(rows, by, order), by, {"gm_rank": F.lit(1).cast("long")})
    sizes = rows.groupBy(*by).agg(F.count("*").alias("gm_n"))
    blocks = numbered.groupBy(*by, F.floor(F.col("gm_rank") / block).cast("long").alias("gm_block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("gm_rank", "gm_x"))), lambda s: s["gm_x"]).alias("gm_values"))
    blocks = scan.matched(blocks, sizes, by).withColumn("gm_group", F.xxhash64(F.lit(0), *by))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.to_dict("records"):
                sums = block_sums(np.asarray(r["gm_values"], float), r["gm_n"], r["gm_block"], block, seed, r["gm_group"], draws)
                yield pd.DataFrame({**{c: [r[c]] * draws for c in by}, "draw": np.arange(draws), "total": sums, "n": r["gm_n"]})

    made = blocks.mapInPandas(run, f"{fields}{', ' if by else ''}draw int, total double, n long")
    return made.groupBy(*by, "draw").agg((F.sum("total") / F.max("n")).alias("mean"))


def interval(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], draws: int = 2_000, seed: int = 1, level: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(by, low, high): the percentile interval of the mean. A group's ``draws`` means are sorted in one task."""
    edge = (1 - level) / 2
    means = draw_means(df, by, value, order, draws, seed, block)
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(edge)).alias("low"), F.percentile("mean", F.lit(1 - edge)).alias("high"))
