"""Jobs on a distribution network: protected nodes, aggregation, connectors, copies, tables from elements
(G07-G09, B05, B08, B12).

Tables: nodes (node, kv), edges (edge_id, a, b, is_switch, is_transformer), loads (load_id, node, kw).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import components, degrees
from .quantiles import quantiles
from .scratch import cut, small

#: The least voltage and degree of a branch point, the voltage of transformers that are kept, the quantile
#: of load, and what still counts as a small leaf, in kW and nodes.
BRANCH_KV, BRANCH_DEGREE, HIGH_KV, LOAD_QUANTILE, LEAF_KW, LEAF_NODES = 7.2, 3, 69.0, 0.95, 50.0, 2


def protected_nodes(nodes: DataFrame, edges: DataFrame, loads: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, reasons): roots, branch points, large loads, ends of switches and of high-voltage transformers."""
    kv = nodes.select("node", "kv")
    branch = degrees(edges).where(F.col("degree") >= BRANCH_DEGREE).join(kv.where(F.col("kv") >= BRANCH_KV), "node").select("node", F.lit("branch").alias("reason"))
    by_node = loads.groupBy("node").agg(F.sum("kw").alias("kw"))
    by_node = cut(by_node, "load-by-node")
    least = quantiles(by_node, [], "kw", [LOAD_QUANTILE], ["least"])
    large = by_node.crossJoin(F.broadcast(least)).where("kw >= least").select("node", F.lit("load").alias("reason"))  # one row
    ends = edges.select("edge_id", "is_switch", "is_transformer", F.explode(F.array("a", "b")).alias("node"))
    switch = ends.where("is_switch").select("node", F.lit("switch").alias("reason"))
    high = ends.where("is_transformer").join(kv, "node").groupBy("edge_id").agg(F.max("kv").alias("kv"), F.count("kv").alias("n"), F.collect_list("node").alias("both"))
    high = high.where((F.col("kv") >= HIGH_KV) & (F.col("n") == 2)).select(F.explode("both").alias("node"), F.lit("transformer").alias("reason"))
    root = roots.select("node", F.lit("root").alias("reason"))
    found = root.unionByName(branch).unionByName(large).unionByName(switch).unionByName(high)
    return found.groupBy("node").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def aggregated(nodes: DataFrame, edges: DataFrame, loads: DataFrame, protected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, members, links) of the network between protected nodes.

    The nodes that aren't protected fall into connected parts. ``parts``: (part, kind, n_nodes, kw, n_boundary): a small
    leaf is merged into its boundary node, a part without load between two boundary nodes is a corridor, others are
    radial (one boundary node) or complex. ``members``: (node, target): what each node becomes, itself if it is protected;
    corridors become nothing. ``links``: (a, b, edge_type, n_edges) between targets, parallel ones as one.
    """
    kept = protected.select("node")
    free = nodes.select("node").join(kept, "node", "left_anti")
    inner = edges.join(free.withColumnRenamed("node", "a"), "a").join(free.withColumnRenamed("node", "b"), "b")
    part = cut(components(free, inner.select("a", "b")).withColumnRenamed("component", "part"), "network-parts")
    both = edges.select("edge_id", "is_transformer", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select("edge_id", "is_transformer", F.col("b").alias("node"), F.col("a").alias("other")))
    touching = both.join(part, "node").join(kept.select(F.col("node").alias("other"), F.lit(True).alias("is_kept")), "other", "left")
    around = touching.groupBy("part").agg(F.array_sort(F.collect_set(F.when(F.col("is_kept"), F.col("other")))).alias("boundary"), F.bool_or("is_transformer").alias("has_transformer"))
    load = loads.join(part, "node").groupBy("part").agg(F.sum("kw").alias("kw"))
    sizes = part.groupBy("part").agg(F.count("*").alias("n_nodes"))
    met = sizes.join(load, "part", "left").join(around, "part", "left").select("part", "n_nodes", F.coalesce("kw", F.lit(0.0)).alias("kw"), F.coalesce("boundary", F.array().cast(around.schema["boundary"].dataType)).alias("boundary"), F.coalesce("has_transformer", F.lit(False)).alias("has_transformer"))
    n = F.size("boundary")
    kind = (
        F.when((n == 1) & (F.col("kw") < LEAF_KW) & (F.col("n_nodes") <= LEAF_NODES) & ~F.col("has_transformer"), "merged_leaf")
        .when((n == 2) & (F.col("kw") == 0), "corridor")
        .when(n == 1, "radial")
        .otherwise("complex")
    )
    parts = cut(met.select("part", kind.alias("kind"), "n_nodes", "kw", n.cast("long").alias("n_boundary"), "boundary"), "network-kinds")
    target = F.when(F.col("kind") == "merged_leaf", F.get("boundary", F.lit(0))).when(F.col("kind") != "corridor", F.col("part"))
    members = part.join(parts.select("part", target.alias("target")), "part").select("node", "target").unionByName(kept.select("node", F.col("node").alias("target")))
    ends = edges.join(members.select(F.col("node").alias("a"), F.col("target").alias("ta")), "a").join(members.select(F.col("node").alias("b"), F.col("target").alias("tb")), "b")
    plain = ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), F.when(F.col("is_transformer"), "transformer").when(F.col("is_switch"), "switch").otherwise("line").alias("edge_type"))
    ways = parts.where("kind = 'corridor'").select(F.get("boundary", F.lit(0)).alias("a"), F.get("boundary", F.lit(1)).alias("b"), F.lit("corridor").alias("edge_type"))
    links = plain.unionByName(ways).groupBy("a", "b", "edge_type").agg(F.count("*").alias("n_edges"))
    return parts, members, links


def connectors(nodes: DataFrame, edges: DataFrame, loads: DataFrame, root: DataFrame) -> DataFrame:
    """(component, node, kw): for each component with load but without a root, the node that a connector goes to, the
    least of them."""
    found = components(nodes, edges.select("a", "b"))
    live = found.join(root, "node", "left_semi").select("component").distinct()
    dark = found.join(live, "component", "left_anti")
    kw = dark.join(loads.groupBy("node").agg(F.sum("kw").alias("kw")), "node", "left")
    return kw.groupBy("component").agg(F.min("node").alias("node"), F.coalesce(F.sum("kw"), F.lit(0.0)).alias("kw")).where("kw > 0")


def line_table(elements: DataFrame) -> DataFrame:
    """(name, bus1, bus2, phases, length, r, x) of line elements (class, name, properties): a line's own impedance, else
    that of its line code, else nulls; phases as given or else as many as the first bus names, or three."""
    get = lambda k: F.element_at(F.col("properties")[k], -1)
    bus = lambda k: F.lower(F.element_at(F.split(get(k), r"\."), 1))
    named = F.size(F.split(get("bus1"), r"\.")) - 1
    lines = elements.where("class = 'line'").select(
        "name", bus("bus1").alias("bus1"), bus("bus2").alias("bus2"), F.coalesce(get("phases").cast("int"), F.when(named > 0, named), F.lit(3)).alias("phases"),
        get("length").cast("double").alias("length"), get("r1").cast("double").alias("r1"), get("x1").cast("double").alias("x1"), F.lower(get("linecode")).alias("code"),
    )
    known = elements.where("class = 'linecode'").select(F.col("name").alias("code"), get("r1").cast("double").alias("code_r"), get("x1").cast("double").alias("code_x"))
    met = lines.join(known, "code", "left")
    return met.select("name", "bus1", "bus2", "phases", "length", F.coalesce("r1", "code_r").alias("r"), F.coalesce("x1", "code_x").alias("x"))


def feeder_votes(lines: DataFrame) -> DataFrame:
    """(bus, feeder): the feeder that most of a bus's lines (bus1, bus2, feeder) belong to, the least of equals."""
    seen = lines.select(F.explode(F.array("bus1", "bus2")).alias("bus"), "feeder").groupBy("bus", "feeder").agg(F.count("*").alias("n"))
    return seen.groupBy("bus").agg(F.min_by("feeder", F.struct((-F.col("n")).alias("n"), "feeder")).alias("feeder"))


def copies(nodes: DataFrame, edges: DataFrame, loads: DataFrame, regions: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A composite case: the network once for each of a few regions (region, dx, dy), with the region's prefix and offset.

    Nodes (node, region, x, y), edges (edge_id, a, b, kind) and loads (load_id, node, kw, is_critical). In each copy the
    largest ``share`` of the loads, one at least, is critical. Each copy has a source joined to its root (the node with
    the least id), and the sources of all copies a common backbone source.
    """
    few = small(regions)
    name = lambda c: F.concat(F.col("region"), F.lit("__"), F.col(c).cast("string"))
    own = nodes.crossJoin(few).select(name("node").alias("node"), "region", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    inside = edges.crossJoin(few).select(name("edge_id").alias("edge_id"), name("a").alias("a"), name("b").alias("b"), F.lit("line").alias("kind"))
    root = nodes.agg(F.min("node").alias("root")).crossJoin(few)
    source = F.concat(F.col("region"), F.lit("__source"))
    heads = root.select(F.concat(F.col("region"), F.lit("__head")).alias("edge_id"), source.alias("a"), name("root").alias("b"), F.lit("source").alias("kind"))
    backbone = regions.select(F.concat(F.col("region"), F.lit("__backbone")).alias("edge_id"), F.lit("grid_source").alias("a"), source.alias("b"), F.lit("backbone").alias("kind"))
    sources = regions.select(source.alias("node"), "region", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    place = F.row_number().over(W.partitionBy("region").orderBy(F.desc("kw"), "load_id"))
    total = F.count("*").over(W.partitionBy("region"))
    each = loads.crossJoin(few)
    each = each.withColumn("is_critical", place <= F.greatest(F.lit(1), F.ceil(F.lit(share) * total)))
    return own.unionByName(sources), inside.unionByName(heads).unionByName(backbone), each.select(name("load_id").alias("load_id"), name("node").alias("node"), "kw", "is_critical")
