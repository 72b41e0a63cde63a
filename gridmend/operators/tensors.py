"""Graphs of many states as padded index arrays in batches of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scan
from .scratch import cut

#: Bytes of a batch: two indices, a mask and the features of each padded edge.
BATCH_BYTES = 8 << 20


def packed(edges: DataFrame, state: str, a: str, b: str, features: Sequence[str], multiple: int = 8, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(state, batch, n_nodes, n_edges, nodes, source, target, mask, features) for each state of ``edges``.

    Nodes of a state are renumbered from 0 in their order; ``nodes`` has their names by number. Edges are sorted by their numbers and
    features and padded with 0 to a ``multiple``; ``mask`` tells which are real. ``features`` is one array for each edge. States are laid out
    in their order and belong to the batch in which they end, so a batch has ``batch_bytes`` and less than one state more. Edges without
    both ends are left out. A state is one row, which must fit in a task's memory.
    """
    own = edges.where(F.col(state).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(state).alias("state"), F.col(a).alias("a"), F.col(b).alias("b"), F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).alias("x"))
    # edges are shuffled once, by state: both ends are numbered and rows of states made where a state is
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda far, node: F.struct(F.lit(far).alias("far"), F.col(node).alias("node"))
    ends = own.repartition(parts, "state").select("state", "a", "b", "x", F.explode(F.array(side(False, "a"), side(True, "b"))).alias("end")).select("state", "a", "b", "x", "end.*")
    numbered = ends.withColumn("i", F.dense_rank().over(W.partitionBy("state").orderBy("node")) - 1)
    # edges that are alike have the same numbers, so sorted lists of both ends match
    of = lambda far: F.sort_array(F.collect_list(F.when(F.col("far") == far, F.struct("a", "b", "x", "i"))))
    rows = numbered.groupBy("state").agg(of(False).alias("near"), of(True).alias("far"), F.sort_array(F.collect_set(F.struct("i", "node"))).alias("names"))
    each = F.zip_with("near", "far", lambda p, q: F.struct(p["i"].alias("source"), q["i"].alias("target"), p["x"].alias("x")))
    rows = rows.select("state", F.sort_array(each).alias("e"), F.transform("names", lambda s: s["node"]).alias("nodes"))
    n = F.size("e")
    size = F.ceil(n / multiple).cast("int") * multiple
    pad = lambda values, empty: F.concat(values, F.array_repeat(empty, size - n))
    made = rows.select(
        "state",
        F.size("nodes").alias("n_nodes"),
        n.alias("n_edges"),
        "nodes",
        pad(F.transform("e", lambda s: s["source"]), F.lit(0)).alias("source"),
        pad(F.transform("e", lambda s: s["target"]), F.lit(0)).alias("target"),
        pad(F.transform("e", lambda s: F.lit(True)), F.lit(False)).alias("mask"),
        pad(F.transform("e", lambda s: s["x"]), F.array_repeat(F.lit(0.0), len(features))).alias("features"),
        (size * (9 + 8 * len(features))).cast("long").alias("gm_bytes"),
    )
    made = cut(made, "tensors")  # once: ranges are drawn from a sample, for which the rest would run again
    before = scan.sums_before(scan.placed(made.select("state", "gm_bytes"), [], ["state"]), [], {"gm_start": F.col("gm_bytes")})
    batch = before.select("state", F.floor((F.col("gm_start") + F.col("gm_bytes") - 1) / batch_bytes).alias("batch"))
    return made.join(batch, "state").select("state", "batch", "n_nodes", "n_edges", "nodes", "source", "target", "mask", "features")


def unpacked(tensors: DataFrame) -> DataFrame:
    """(state, a, b, features) of the edges again."""
    each = tensors.select("state", "nodes", F.explode(F.arrays_zip("source", "target", "mask", "features")).alias("e")).where("e.mask")
    return each.select("state", F.get("nodes", F.col("e.source")).alias("a"), F.get("nodes", F.col("e.target")).alias("b"), "e.features")
