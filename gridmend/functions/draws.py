"""Random numbers that a seed and a key decide, wherever a row is and however often it is computed."""

from __future__ import annotations

import hashlib
from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / F.lit(2.0**52)


def uniform_of(seed: int, *keys: object) -> float:
    """The same number in Python; keys are whole numbers or strings."""
    digest = hashlib.sha256("|".join(map(str, (seed, *keys))).encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / 2.0**52


def exponential_of(mean: float, seed: int, *keys: object) -> float:
    return -mean * log(uniform_of(seed, *keys))


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal, from two uniform numbers."""
    u, v = (uniform(seed, *keys, F.lit(k)) for k in ("radius", "angle"))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2 * pi * v)


def poisson(mean: Column, u: Column, most: int = 200) -> Column:
    """How many of the cumulative probabilities of 0 to ``most`` - 1 lie below ``u``."""

    def step(a: Column, k: Column) -> Column:
        total = a["total"] + a["term"]
        return F.struct((a["term"] * mean / (k + 1)).alias("term"), total.alias("total"), (a["n"] + F.when(total < u, 1).otherwise(0)).alias("n"))

    start = F.struct(F.exp(-mean).alias("term"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), start, step, lambda a: a["n"])
