"""Sharding by a hierarchical weighted hash tree, in DataFrame code.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, u a uniform number hashed
from the row's key and the child's path, and the least draw wins; so a child gets its weight's share, and raising
one child's weight only moves rows into that child, whose subtree alone is descended anew. Shards beyond the
first ``base`` each open a region of their own, so that one more shard takes rows only into itself (law ``key``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, table, written

#: Rows that one numbering group should hold, and the least number of groups for each shard.
GROUP_ROWS, LEAST_GROUPS = 50_000, 64
#: The most copies that one array is made for when repeated rows are numbered.
CHUNK = 65_536


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; ``shard`` is set on leaves. An inner node weighs what its leaves weigh."""

    path: str
    own: float = 0.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(n_shards: int, base: int = 24, per_rack: int = 4, per_region: int = 12, weights: dict[int, float] | None = None) -> Node:
    """The tree over shards 0 to n_shards - 1. ``weights`` gives shards another weight than 1."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    if any(not 0 <= w < float("inf") for w in (weights or {}).values()):
        raise ValueError("weights are finite numbers that aren't negative")

    def leaf(i: int, at: str) -> Node:
        return Node(f"{at}/s{i}", float((weights or {}).get(i, 1.0)), i)

    regions = []
    for first in range(0, min(n_shards, base), per_region):
        at = f"g{first // per_region}"
        racks = []
        for start in range(first, min(first + per_region, base, n_shards), per_rack):
            rack = f"{at}/k{(start - first) // per_rack}"
            racks.append(Node(rack, children=tuple(leaf(i, rack) for i in range(start, min(start + per_rack, first + per_region, base, n_shards)))))
        regions.append(Node(at, children=tuple(racks)))
    regions += [Node(at := f"x{i}", children=(Node(f"{at}/k0", children=(leaf(i, f"{at}/k0"),)),)) for i in range(base, n_shards)]
    return Node("", children=tuple(regions))


def hashed(label: Column) -> Column:
    """52 bits of a digest."""
    return F.conv(F.substring(F.md5(label), 1, 13), 16, 10).cast("long")


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1]."""
    bits = hashed(F.concat(key, F.lit(f":{node.path}")))
    return -F.log((bits + 1) / F.lit(2.0**52)) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard of a key, a string, below ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if not children:
        raise ValueError(f"no shard below {node.path or 'the root'} has a weight")
    if len(children) == 1:
        return descend(key, children[0])
    winner = F.least(*(F.struct(draw(key, c).alias("draw"), F.lit(i).alias("at")) for i, c in enumerate(children)))["at"]
    return let(winner, lambda at: _branch(at, key, children))


def _branch(at: Column, key: Column, children: list[Node]) -> Column:
    chosen = None
    for i, c in enumerate(children):
        chosen = F.when(at == i, descend(key, c)) if chosen is None else chosen.when(at == i, descend(key, c))
    return chosen


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def assign(docs: DataFrame, n_shards: int = 24, shard_col: str = "shard", **shape) -> DataFrame:
    """``docs`` with the shard of each row; no shuffle. Null ids share one shard; equal ids always do."""
    return docs.withColumn(shard_col, descend(key_of(F.col("doc_id")), tree(n_shards, **shape)).cast("int"))


def numbered(rows: DataFrame, shard_col: str = "shard") -> DataFrame:
    """``rows`` with a ``slot`` that counts each shard's rows from 0 without a gap; a column of that name is replaced.

    Equal rows are counted before the shuffle. Rows are dealt over groups within each shard by a hash; a group
    knows where it begins from the groups' sizes, and only numbers its own rows.
    """
    names = rows.columns
    columns = [f"c{i}" for i in range(len(names))]  # names of our own, so that none can clash
    shard = columns[[n.lower() for n in names].index(shard_col.lower())]
    rows = rows.toDF(*columns)
    counted = written(rows.groupBy(*columns).agg(F.count("*").alias("copies")), "shard-rows")
    total = counted.agg(F.sum("copies")).first()[0] or 0
    groups = max(LEAST_GROUPS, total // GROUP_ROWS)
    label = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    dealt = counted.withColumn("part", hashed(label) % groups)
    sizes = dealt.groupBy(shard, "part").agg(F.sum("copies").alias("size"))
    before = W.partitionBy(shard).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("in_shard"), F.col("part").alias("at"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inner = W.partitionBy(shard, "part").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("copies").over(inner), F.lit(0)))
    met = placed.join(starts, (F.col(shard) == F.col("in_shard")) & (F.col("part") == F.col("at")))
    chunks = met.select(*columns, (F.col("start") + F.col("ahead")).alias("first"), "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))).alias("chunk"))
    inside = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("copies")) - 1)
    each = chunks.select(*columns, "first", F.explode(inside).alias("i"))
    return each.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True) if n.lower() != "slot"), (F.col("first") + F.col("i")).alias("slot"))


def op4_sharding(spark, sf_dir: str, n_shards: int = 24) -> DataFrame:
    """Every document's shard of ``n_shards``, its place there, and its shard if there were one more.

    Null texts have no bytes, very long ones count whole, null ids share a shard. Repeated rows stay apart and get slots
    of their own. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    bytes_of = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(bytes_of) + 8).cast("long").alias("size"),
        F.crc32(bytes_of.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = assign(assign(rows, n_shards), n_shards + 1, "grown_shard")
    return numbered(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
