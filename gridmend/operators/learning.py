"""Observations, labels and message passing for repair policies (G12, L05, L06, L08, L12, ST06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scan


def dot(weights: Sequence[float], x: Column) -> Column:
    return sum((F.lit(float(w)) * F.get(x, F.lit(i)) for i, w in enumerate(weights)), F.lit(0.0))


def linear(matrix: Sequence[Sequence[float]], bias: Sequence[float], x: Column) -> Column:
    """matrix x + bias as an array expression."""
    return F.array(*(dot(row, x) + float(b) for row, b in zip(matrix, bias, strict=True)))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def message_passing(nodes: DataFrame, edges: DataFrame, matrix: Sequence[Sequence[float]], bias: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, x): each node's features plus the mean of its messages, in both directions of each edge.

    A message is relu(matrix [features of the other end, features of the edge] + bias). Sums of components are
    combined before the shuffle, so a node with many edges is no hot key. ``nodes``: node, x; ``edges``: a, b, e.
    """
    keys, width = list(keys), len(bias)
    both = edges.select(*keys, F.col("a").alias("to"), F.col("b").alias("node"), "e").unionByName(edges.select(*keys, F.col("b").alias("to"), F.col("a").alias("node"), "e"))
    sent = both.join(nodes.select(*keys, "node", "x"), [*keys, "node"]).select(*keys, F.col("to").alias("node"), relu(linear(matrix, bias, F.concat("x", "e"))).alias("m"))
    mean = sent.groupBy(*keys, "node").agg(*(F.avg(F.get("m", F.lit(i))).alias(f"m{i}") for i in range(width)))
    met = nodes.join(mean, [*keys, "node"], "left")
    new = F.array(*(F.get("x", F.lit(i)) + F.coalesce(f"m{i}", F.lit(0.0)) for i in range(width)))
    return met.select(*keys, "node", new.alias("x"))


def mlp(layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]], x: Column) -> Column:
    """The output array of a perceptron, relu between its layers, as one expression: scores of a table in the JVM."""
    for i, (matrix, bias) in enumerate(layers):
        x = linear(matrix, bias, x if i == 0 else relu(x))
    return x


def masked_softmax(scored: DataFrame, by: Sequence[str], score: str, mask: str, out: str = "p") -> DataFrame:
    """Probabilities of the candidates of each state; those that are masked out have none."""
    w = W.partitionBy(*by)
    valid = F.when(F.col(mask), F.col(score))
    e = F.exp(valid - F.max(valid).over(w))
    return scored.withColumn(out, F.coalesce(e / F.sum(e).over(w), F.lit(0.0)))


def convolved(cells: DataFrame, keys: Sequence[str], value: str, kernel: Sequence[Sequence[float]], bias: float, size: int) -> DataFrame:
    """(keys, cy, cx, value): relu of a 3 x 3 convolution over sparse raster cells (keys, cy, cx, value), padded by zeros.

    A cell sends its weighted value to its neighbours, and sums are combined before the shuffle; cells that nothing
    reaches hold relu(bias) and aren't in the result.
    """
    sent = F.explode(F.array(*(F.struct(F.lit(1 - i).alias("dy"), F.lit(1 - j).alias("dx"), F.lit(float(w)).alias("w")) for i, row in enumerate(kernel) for j, w in enumerate(row))))
    x = cells.select(*keys, "cy", "cx", F.col(value).alias("gm_v"), sent.alias("k"))
    x = x.select(*keys, (F.col("cy") + F.col("k.dy")).alias("cy"), (F.col("cx") + F.col("k.dx")).alias("cx"), (F.col("gm_v") * F.col("k.w")).alias("gm_v"))
    inside = x.where(F.col("cy").between(0, size - 1) & F.col("cx").between(0, size - 1))
    return inside.groupBy(*keys, "cy", "cx").agg(F.greatest(F.lit(0.0), F.sum("gm_v") + bias).alias(value))


def lookahead_costs(repairs: DataFrame, by: Sequence[str], horizon: int = 5) -> DataFrame:
    """(by, node, cost): energy not served over the next ``horizon`` repairs if ``node`` is repaired first and the others
    follow by power for each hour. ``repairs``: by, node, mw, hours. A candidate meets ``horizon`` others at most."""
    by = list(by)
    state = W.partitionBy(*by)
    order = (F.col("mw") / F.greatest("hours", F.lit(0.1))).desc(), F.col("hours"), F.col("node").desc()
    ranked = repairs.select(*by, "node", "mw", "hours", F.sum("mw").over(state).alias("total"), F.row_number().over(state.orderBy(*order)).alias("place"))
    top = ranked.where(F.col("place") <= horizon).select(*by, F.col("node").alias("other"), F.col("mw").alias("other_mw"), F.col("hours").alias("other_hours"), "place")
    met = ranked.drop("place").join(top, by).where("node <> other")
    run = W.partitionBy(*by, "node").orderBy("place")
    met = met.withColumns({"n": F.row_number().over(run), "before": F.coalesce(F.sum("other_mw").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))}).where(F.col("n") < horizon)
    later = met.groupBy(*by, "node").agg(F.sum(F.col("other_hours") * (F.col("total") - F.col("mw") - F.col("before"))).alias("later"))
    return ranked.join(later, [*by, "node"], "left").select(*by, "node", (F.col("total") * F.col("hours") + F.coalesce("later", F.lit(0.0))).alias("cost"))


def padded_candidates(scored: DataFrame, by: Sequence[str], order: Sequence[Column], features: Sequence[str], id_: str, k: int = 50) -> DataFrame:
    """(by, ids, features, mask): the first ``k`` candidates of each state as arrays of length k, padded with zeros."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    kept = scored.withColumn("gm_place", place).where(F.col("gm_place") <= k)
    row = F.struct("gm_place", F.col(id_).alias("id"), F.array(*(F.col(f).cast("double") for f in features)).alias("f"))
    rows = kept.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("r"))  # k rows at most
    pad = k - F.size("r")
    blank = F.array(*(F.lit(0.0) for _ in features))
    return rows.select(
        *by,
        F.concat(F.transform("r", lambda x: x["id"]), F.array_repeat(F.lit(-1).cast(scored.schema[id_].dataType), pad)).alias("ids"),
        F.concat(F.transform("r", lambda x: x["f"]), F.array_repeat(blank, pad)).alias("features"),
        F.concat(F.array_repeat(F.lit(True), F.size("r")), F.array_repeat(F.lit(False), pad)).alias("mask"),
    )


def lookahead_labels(costs: DataFrame, by: Sequence[str], cost: str, id_: str) -> DataFrame:
    """The cheapest candidate of each state, the least id among equals, and how much worse the mean candidate is."""
    best = F.min(F.struct(F.col(cost).alias("c"), F.col(id_).alias("i")))
    return costs.groupBy(*by).agg(best["i"].alias("label"), best["c"].alias("best"), (F.avg(cost) - F.min(cost)).alias("spread"))


def ranking_metrics(candidates: DataFrame, by: Sequence[str], score: str, cost: str, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Over states of scored candidates: how often the cheapest is among the first k, and the mean regret of the first.
    Among equal scores the cheaper candidate comes first. States of any size: a window, no arrays."""
    state = W.partitionBy(*by)
    ranked = candidates.select(*by, cost, F.row_number().over(state.orderBy(F.desc(score), cost)).alias("place"), F.min(cost).over(state).alias("least"))
    each = ranked.groupBy(*by).agg(F.min(F.when(F.col(cost) == F.col("least"), F.col("place"))).alias("place"), (F.min(F.when(F.col("place") == 1, F.col(cost))) - F.min("least")).alias("regret"))
    return each.agg(F.count("*").alias("n"), *(F.avg((F.col("place") <= k).cast("double")).alias(f"top{k}") for k in ks), F.avg("regret").alias("regret"))


def discounted_advantages(steps: DataFrame, by: Sequence[str], order: str, reward: str, value: str, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """(by, order, advantage): generalised advantages, from each episode's last step to its first.

    An advantage takes those after it and the value of the next step: reward - value + gamma (next value + lam x next advantage).
    With z = advantage + value / lam that is one affine map a step, and a scan of such maps holds no episode in one task.
    """
    r, v = F.col(reward).cast("double"), F.col(value).cast("double")
    rows = scan.placed(steps.select(*by, order, r.alias("gm_r"), v.alias("gm_v")), by, [F.desc(order)])
    gain = F.col("gm_r") - F.col("gm_v")
    if lam:
        known = scan.affine_before(rows, by, F.lit(gamma * lam), gain + F.col("gm_v") / lam, out="gm_z")
        advantage = gain + gamma * lam * F.col("gm_z")
    else:
        known = scan.affine_before(rows, by, F.lit(0.0), F.col("gm_v"), out="gm_z")
        advantage = gain + gamma * F.col("gm_z")
    return known.select(*by, order, advantage.alias("advantage"))
