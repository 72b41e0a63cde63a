"""Reachability, components and outage measures on edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import cut, erase


def normal_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct undirected edges (a < b) without loops."""
    return edges.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), node: str = "node") -> DataFrame:
    """``nodes`` with the least node of their component as ``component``.

    In each round a label becomes the least of its own, those around it, and its label's label, so rounds grow with the
    logarithm of a chain's length. ``keys`` keep graphs apart: many small graphs are solved in one go.
    """
    keys = list(keys)
    both = normal_edges(edges, keys)
    both = cut(both.unionByName(both.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "graph-edges")
    now = cut(nodes.select(*keys, F.col(node).alias("n"), F.col(node).alias("label")).distinct(), "graph-labels")
    while True:
        there = now.select(*keys, F.col("n").alias("b"), F.col("label").alias("near"))
        least = both.join(there, [*keys, "b"]).groupBy(*keys, "a").agg(F.min("near").alias("near"))
        jump = now.select(*keys, F.col("n").alias("label"), F.col("label").alias("jump"))
        met = now.join(least.withColumnRenamed("a", "n"), [*keys, "n"], "left").join(jump, [*keys, "label"], "left")
        moved = met.select(*keys, "n", F.least("label", F.coalesce("near", "label"), F.coalesce("jump", "label")).alias("new"), "label")
        seen = Observation()  # counted while the table is written
        new = cut(moved.observe(seen, F.count_if(F.col("new") != F.col("label")).alias("changed")).select(*keys, "n", F.col("new").alias("label")), "graph-labels")
        erase(now)
        now = new
        if not seen.get["changed"]:
            erase(both)
            return now.select(*keys, F.col("n").alias(node), F.col("label").alias("component"))


def reachable(edges: DataFrame, sources: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node) reachable from ``sources`` (keys, node) over edges (keys, a, b): the components that hold a source.

    So rounds grow with the logarithm of a feeder's length and not with its levels.
    """
    keys = list(keys)
    ends = edges.select(*keys, F.col("a").alias("node")).unionByName(edges.select(*keys, F.col("b").alias("node")))
    first = sources.select(*keys, "node").distinct()
    found = components(ends.unionByName(first).distinct(), edges, keys)
    live = found.join(first, [*keys, "node"], "left_semi").select(*keys, "component").distinct()
    return found.join(live, [*keys, "component"], "left_semi").select(*keys, "node")


#: Cases of a mask.
WORD = 64


def numbered_cases(cases: DataFrame, case: str) -> DataFrame:
    """(case, word, bit) of distinct cases; a narrow row for each case is brought into an order."""
    n = F.row_number().over(W.orderBy(case)) - 1
    return cases.select(case).distinct().select(case, F.floor(n / WORD).cast("int").alias("word"), (n % WORD).alias("bit"))


def _masks(rows: DataFrame, numbers: DataFrame, case: str, keys: Sequence[str]) -> DataFrame:
    hit = rows.join(numbers, case).select(*keys, "word", F.expr("shiftleft(1L, bit)").alias("hit"))
    return hit.groupBy(*keys, "word").agg(F.bit_or("hit").alias("hit"))


def reachable_in_cases(edges: DataFrame, damaged: DataFrame, sources: DataFrame, case: str = "scenario", bundled: bool = True, lost: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """(case, node) that ``sources`` (node) reach over ``edges`` (edge_id, a, b) in each of many damage cases.

    ``damaged``: (case, edge_id). With ``bundled`` a damaged edge blocks all edges between its ends, else parallel edges
    stand in for each other. ``lost``: (case, node) that are out themselves, sources included. ``cases``: all cases, by default those with
    damage.

    A node carries a mask of the cases in which it is reached, 64 to a row. In a round, what a node has gained goes over its edges, less the
    cases that block them, and is united at the other end; so tables have a row for each node or blocked edge and 64 cases, and
    the network isn't copied for each case. Rounds are as many as the longest of the shortest ways.
    """
    every = damaged.select(case) if cases is None else cases.select(case)
    if lost is not None and cases is None:
        every = every.unionByName(lost.select(case))
    numbers = cut(numbered_cases(every, case), "cases")
    pairs = edges.where("a <> b").select("edge_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if bundled:
        hit = _masks(damaged.join(pairs, "edge_id"), numbers, case, ["a", "b"])
    else:
        each = _masks(damaged.join(pairs, "edge_id"), numbers, case, ["a", "b", "edge_id"]).groupBy("a", "b", "word").agg(F.bit_and("hit").alias("hit"), F.count("*").alias("n"))
        hit = each.join(pairs.groupBy("a", "b").agg(F.count_distinct("edge_id").alias("all")), ["a", "b"]).where("n = all").drop("n", "all")
    turned = lambda df, *more: df.select("a", "b", *more).unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), *more))
    links, blocked = cut(turned(pairs.select("a", "b").distinct()), "links"), cut(turned(hit, "word", "hit"), "blocked")
    out = None if lost is None else cut(_masks(lost, numbers, case, ["node"]), "lost")

    def alive(gains: DataFrame) -> DataFrame:
        if out is None:
            return gains
        return gains.join(out, ["node", "word"], "left").select("node", "word", F.col("gain").bitwiseAND(F.bitwise_not(F.coalesce("hit", F.lit(0).cast("long")))).alias("gain"))

    words = numbers.agg(F.max("word")).first()[0]
    if words is None:
        return numbers.select(case).join(sources.select("node"), F.lit(False))
    start = sources.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(words))).alias("word"), F.lit(-1).cast("long").alias("gain"))
    front = cut(alive(start).where("gain <> 0"), "gains")
    gained = [front]
    seen = front.withColumnRenamed("gain", "known")
    while True:
        over = front.withColumnRenamed("node", "a").join(links, "a").join(blocked, ["a", "b", "word"], "left")
        sent = over.select(F.col("b").alias("node"), "word", F.col("gain").bitwiseAND(F.bitwise_not(F.coalesce("hit", F.lit(0).cast("long")))).alias("gain")).where("gain <> 0")
        sent = alive(sent.groupBy("node", "word").agg(F.bit_or("gain").alias("gain")))
        new = sent.join(seen, ["node", "word"], "left").select("node", "word", F.col("gain").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))).alias("gain"))
        count = Observation()
        front = cut(new.where("gain <> 0").observe(count, F.count("*").alias("n")), "gains")
        if not count.get["n"]:
            break
        gained.append(front)
        seen = seen.unionByName(front.withColumnRenamed("gain", "known")).groupBy("node", "word").agg(F.bit_or("known").alias("known"))
        if len(gained) % 8 == 0:
            seen = cut(seen, "seen")
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("known", i) == 1)
    return seen.select("node", "word", F.explode(bits).alias("bit")).join(numbers, ["word", "bit"]).select(case, "node")


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return both.where("node <> other").groupBy("node").agg(F.count_distinct("other").alias("degree"))


def tree_unserved(damage: DataFrame, loads: DataFrame, case: str = "scenario") -> DataFrame:
    """In a tree whose loads hang below feeding nodes, the loads of damaged nodes, by case."""
    return damage.select(case, "node").distinct().join(loads, "node")


def outage_metrics(unserved: DataFrame, case: str = "scenario") -> DataFrame:
    """MW without service, critical MW, dollars an hour, loads, and nodes with load."""
    return unserved.groupBy(case).agg(
        (F.sum("kw") / 1000).alias("unserved_mw"),
        (F.sum(F.when(F.col("is_critical"), F.col("kw")).otherwise(0.0)) / 1000).alias("critical_mw"),
        F.sum(F.col("kw") * F.col("voll")).alias("voll_per_h"),
        F.count("*").alias("n_loads"),
        F.count_distinct("node").alias("n_islands"),
    )
