"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, written

#: Edges that a task joins in memory at a time.
EDGES_TOGETHER = 50_000
#: Parts that a node's edges are dealt into, and parts of the tasks that first agree on a node's least neighbour.
SALTS, GROUPS = 4, 16


def _least(edges: DataFrame) -> DataFrame:
    """(a, m, n): the least b of each a, and its edges. A hub has a candidate from every task, so groups of tasks agree
    first."""
    once = edges.groupBy("a", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("tasks")).agg(F.min("b").alias("b"), F.count("*").alias("n"))
    return once.groupBy("a").agg(F.min("b").alias("m"), F.sum("n").alias("n"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbours and itself.

    Only nodes with a smaller neighbour change anything, and hubs have none: their many edges are dealt by a salt and
    find no partner. As both sides are shuffled for the join, Spark can split what is still too large.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).where("m < a").select(F.col("a").alias("at"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    larger = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    met = larger.join(least, (larger.a == least.at) & (larger.salt == least.part), "left")
    return met.select(F.col("b").alias("a"), F.coalesce("m", larger.a).alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges whose a is the larger end: links the neighbours of a, and a itself, to the least of them. Only nodes with
    several neighbours move any; their edges are dealt by a salt."""
    least = _least(edges)
    several = least.where("n > 1").select(F.col("a").alias("at"), "m", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("part"))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(GROUPS)).cast("int"))
    moved = salted.join(several, (salted.a == several["at"]) & (salted.salt == several.part)).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _forests(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes, as stars within each portion of EDGES_TOGETHER edges of a task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        seen = 0

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, t) for x in root if (t := top(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["a", "b"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root.setdefault(x, x), root.setdefault(y, y)
                x, y = top(x), top(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            seen += b.num_rows
            if seen >= EDGES_TOGETHER:
                yield stars()
                root.clear()
                seen = 0
        if root:
            yield stars()

    return edges.mapInArrow(of, edges.schema)


def members(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) but the roots themselves; a root is its component's least node.

    Loops and repeated edges do no harm; nodes without edges aren't in the result; edges with a null end are
    ignored. Each round is written to the shared folder. A hub's edges meet only in joins, which Spark can split.
    """
    whole = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(_forests(whole).distinct(), "edges")
    mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while mark[0]:
        new = written(_small_star(_large_star(now)), "edges")
        seen = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        erase(now)
        now = new
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """members() with a row for each root too."""
    found = members(edges)
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())
