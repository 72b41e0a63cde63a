"""Nearest neighbours and overlays without pairs of everything.

Points lie in a quadtree of degrees whose cells are split while they hold more than LEAF places. Queries go down it together, a level
at a time: each keeps the cells that may hold one of its nearest points, by bounds on the distance of all that a cell holds.

Polygons are edge tables. Rings are cut to a grid by halving, so that a large ring is never cut as a whole more than once a
level, and what is left of a ring in a cell is a closed ring again. Two polygons then meet cell by cell: the area below both of
two edges, with the edges' signs, adds up to the area that the polygons share, whatever their shape and holes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import plane
from ..functions import scalar as s
from .scan import matched
from .scratch import cut, narrow

#: Places in a cell that is compared one by one, and the level at which no cell is split any more (some 10 m).
LEAF, DEEPEST = 32, 21


def _row(lat: Column, level: int) -> Column:
    return F.least(F.lit((1 << level) - 1), F.floor((lat + 90) / 180 * (1 << level))).cast("long")


def _cell(lat: Column, lon: Column, level: int) -> Column:
    column = F.pmod(F.floor((lon + 180) / 180 * (1 << level)), F.lit(2 << level)).cast("long")
    return _row(lat, level) * (2 << level) + column


def _bounds(cell: Column, level: int, lat: Column, lon: Column) -> tuple[Column, Column]:
    """The least and the largest distance in km of what a cell may hold."""
    size = 180.0 / (1 << level)
    south, west = F.floor(cell / (2 << level)) * size - 90, (cell % (2 << level)) * size - 180
    middle, centre = south + size / 2, west + size / 2
    reach = F.greatest(*(s.haversine_km(middle, centre, y, west) for y in (south, south + size))) * (1 + 1e-9) + 1e-6
    away = s.haversine_km(lat, lon, middle, centre)
    return F.greatest(F.lit(0.0), away - reach), away + reach


def _tree(points: DataFrame) -> list[DataFrame]:
    """For each level (cell, n, leaf): how many points its cells hold, and whether a cell isn't split."""
    levels, open_ = [], points.groupBy("lat", "lon").agg(F.sum("n").alias("n"))
    for level in range(DEEPEST + 1):
        cells = cut(open_.groupBy(_cell(F.col("lat"), F.col("lon"), level).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("places")), f"cells-{level}")
        levels.append(cells.select("cell", "n", (F.lit(level == DEEPEST) | (F.col("places") <= LEAF)).alias("leaf")))
        split = levels[-1].where("not leaf").select("cell")
        if split.isEmpty():
            break
        open_ = open_.withColumn("cell", _cell(F.col("lat"), F.col("lon"), level)).join(narrow(split), "cell", "left_semi").drop("cell")
    return levels


def neighbours(queries: DataFrame, points: DataFrame, k: int = 1, within_km: float | None = None) -> DataFrame:
    """(query, id, km): the ``k`` nearest of ``points`` (id, lat, lon) for each of ``queries`` (query, lat, lon), the least id
    among equals; with ``within_km`` all points within that distance instead.

    Rows without a coordinate are in no result. Points at one place are thinned to ``k`` before they are compared, so a place may
    hold any number; a query that occurs twice is answered once. With fewer than ``k`` points a query gets all of them.
    """
    asked = queries.select("query", F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).where("qlat is not null and qlon is not null").distinct()
    known = points.select("id", "lat", "lon").where("lat is not null and lon is not null")
    if within_km is None:
        known = known.withColumn("i", F.row_number().over(W.partitionBy("lat", "lon").orderBy("id"))).where(F.col("i") <= k).drop("i")
    known = cut(known.withColumn("n", F.lit(1)), "places")
    levels = _tree(known)
    bound = F.lit(float("inf") if within_km is None else float(within_km))
    front = asked.select("*", bound.alias("most"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("cell"))
    leaves = None
    for level, cells in enumerate(levels):
        met = front.join(narrow(cells), "cell")
        least, most = _bounds(F.col("cell"), level, F.col("qlat"), F.col("qlon"))
        met = met.withColumns({"low": least, "high": most})
        if within_km is None:
            near = W.partitionBy("query", "qlat", "qlon")
            met = met.withColumn("upto", F.sum("n").over(near.orderBy("high", "cell")))
            met = met.withColumn("most", F.least("most", F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("high"))).over(near), F.lit(float("inf"))))).drop("upto")
        met = cut(met.where(F.col("low") <= F.col("most")), f"front-{level}")
        found = met.where("leaf").select("query", "qlat", "qlon", F.lit(level).alias("level"), "cell", "low")
        leaves = found if leaves is None else leaves.unionByName(found)
        down = (F.floor(F.col("cell") / (2 << level)) * 2, (F.col("cell") % (2 << level)) * 2)
        children = F.array(*(((down[0] + y) * (4 << level) + down[1] + x).cast("long") for y in (0, 1) for x in (0, 1)))
        front = met.where("not leaf").select("query", "qlat", "qlon", "most", F.explode(children).alias("cell"))
    placed = None
    for level, cells in enumerate(levels):
        own = known.withColumns({"level": F.lit(level), "cell": _cell(F.col("lat"), F.col("lon"), level)}).join(narrow(cells.where("leaf").select("cell")), "cell", "left_semi")
        placed = own if placed is None else placed.unionByName(own)
    met = leaves.join(placed, ["level", "cell"]).withColumn("km", s.haversine_km(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")))
    if within_km is not None:
        return met.where(F.col("km") <= within_km).select("query", "id", "km")
    place = F.row_number().over(W.partitionBy("query").orderBy("km", "id"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("query", "id", "km")


# polygons


def oriented(rings: Column) -> Column:
    """Rings with the first one counter-clockwise and the others, its holes, clockwise."""
    turned = lambda r, i: F.when((plane.area(r) > 0) == (i == 0), r).otherwise(F.reverse(r))
    return F.transform(rings, turned)


def edge_table(polygons: DataFrame, box: tuple[float, float, float, float], depth: int) -> DataFrame:
    """(id, cell, x1, y1, x2, y2, sign) of ``polygons`` (id, rings) within ``box``, cut to 2^depth x 2^depth cells.

    ``rings``: the outer one and its holes, arrays of points. Rows of one id are parts of one polygon. Rings without an area have
    no edges; null rings are no polygon. Upright edges bound no area below them and are left out. An edge is given from left to right; its sign is
    1 where the polygon lies below it.
    """
    rings = polygons.select("id", F.explode(oriented(F.col("rings"))).alias("ring")).where(F.size("ring") >= 3)
    left, low, right, high = box
    pieces = rings.select("id", "ring", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    pieces = pieces.withColumn("ring", plane.clipped(F.col("ring"), box))
    for level in range(1, depth + 1):
        w, h = (right - left) / (1 << level), (high - low) / (1 << level)
        halves = F.explode(F.array(*(F.struct((F.col("cx") * 2 + x).alias("cx"), (F.col("cy") * 2 + y).alias("cy")) for x in (0, 1) for y in (0, 1)))).alias("c")
        each = pieces.where(F.size("ring") >= 3).select("id", "ring", halves).select("id", "ring", "c.cx", "c.cy")
        own = (left + F.col("cx") * w, low + F.col("cy") * h, left + (F.col("cx") + 1) * w, low + (F.col("cy") + 1) * h)
        pieces = cut(each.withColumn("ring", plane.clipped(F.col("ring"), own)).where(F.size("ring") >= 3), f"pieces-{level}")
    edges = pieces.select("id", (F.col("cx") * (1 << depth) + F.col("cy")).alias("cell"), F.explode(plane.sides(F.col("ring"))).alias("e")).where(F.col("e.p")[0] != F.col("e.q")[0])
    back = F.col("e.p")[0] > F.col("e.q")[0]
    at = lambda a, b, k: F.when(back, F.col(f"e.{a}")[k]).otherwise(F.col(f"e.{b}")[k])
    return edges.select("id", "cell", at("q", "p", 0).alias("x1"), at("q", "p", 1).alias("y1"), at("p", "q", 0).alias("x2"), at("p", "q", 1).alias("y2"), F.when(back, 1).otherwise(-1).alias("sign"))


def shared_areas(a: DataFrame, b: DataFrame, box: tuple[float, float, float, float], depth: int = 4) -> DataFrame:
    """(a, b, area) of pairs of polygons (id, rings) that share more than a border within ``box``."""
    other = edge_table(b, box, depth).select("cell", *(F.col(c).alias(f"o_{c}") for c in ("id", "x1", "y1", "x2", "y2", "sign")))
    met = edge_table(a, box, depth).join(other, "cell").where((F.col("x1") < F.col("o_x2")) & (F.col("o_x1") < F.col("x2")))
    x1, x2 = F.greatest("x1", "o_x1"), F.least("x2", "o_x2")
    height = lambda p, x: F.col(f"{p}y1") + (F.col(f"{p}y2") - F.col(f"{p}y1")) * (x - F.col(f"{p}x1")) / (F.col(f"{p}x2") - F.col(f"{p}x1")) - box[1]
    met = met.select("id", "o_id", (F.col("sign") * F.col("o_sign")).alias("sign"), (x2 - x1).alias("w"), height("", x1).alias("l"), height("", x2).alias("r"), height("o_", x1).alias("ol"), height("o_", x2).alias("or"))
    dl, dr = F.col("l") - F.col("ol"), F.col("r") - F.col("or")
    t = dl / (dl - dr)  # where they cross
    least_l, least_r, cross = F.least("l", "ol"), F.least("r", "or"), F.col("l") + t * (F.col("r") - F.col("l"))
    below = F.when(dl * dr < 0, ((least_l + cross) * t + (cross + least_r) * (1 - t)) / 2).otherwise((least_l + least_r) / 2) * F.col("w")
    found = met.groupBy(F.col("id").alias("a"), F.col("o_id").alias("b")).agg(F.sum(F.col("sign") * below).alias("area"))
    return found.where(F.col("area") > 1e-9 * (box[2] - box[0]) * (box[3] - box[1]))


def holders(points: DataFrame, polygons: DataFrame, box: tuple[float, float, float, float], depth: int = 4) -> DataFrame:
    """(point, id): the polygons (id, rings) that ``points`` (point, x, y) of the box lie in. Points on the border to the left of or below
    a polygon's inside are in it. A point meets the edges of its cell only."""
    left, low, right, high = box
    along = lambda c, a, b: F.least(F.lit((1 << depth) - 1), F.floor((F.col(c) - a) / (b - a) * (1 << depth))).cast("long")
    own = points.where((F.col("x") >= left) & (F.col("x") <= right) & (F.col("y") >= low) & (F.col("y") <= high))
    own = own.select("point", "x", "y", (along("x", left, right) * (1 << depth) + along("y", low, high)).alias("cell"))
    met = own.join(edge_table(polygons, box, depth), "cell").where((F.col("x1") <= F.col("x")) & (F.col("x") < F.col("x2")))
    above = F.col("y1") + (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1")) / (F.col("x2") - F.col("x1")) > F.col("y")
    return met.where(above).groupBy("point", "id").agg(F.sum("sign").alias("times")).where("times > 0").select("point", "id")


def holder_counts(points: DataFrame, polygons: DataFrame, box: tuple[float, float, float, float], depth: int = 4) -> DataFrame:
    """(id, points): how many ``points`` (point, x, y) lie in each of the polygons (id, rings) that hold any; a point has one place.

    Points at one place and polygons of one shape are compared once, and their numbers multiplied; so work grows with different places
    and shapes, and pairs of a point and a polygon are never made.
    """
    n = F.count("*").alias("n")
    places = points.distinct().groupBy("x", "y").agg(n).select(F.struct("x", "y", "n").alias("point"), "x", "y")
    whole = polygons.groupBy("id").agg(F.array_sort(F.collect_list("rings")).alias("parts"))  # rows of one id are parts of one polygon
    whole = cut(whole.select("id", F.sha2(F.col("parts").cast("string"), 256).alias("shape"), "parts"), "shapes")
    shapes = whole.groupBy("shape").agg(F.first("parts").alias("parts")).select(F.col("shape").alias("id"), F.explode("parts").alias("rings"))
    found = holders(cut(places, "points"), shapes, box, depth).groupBy(F.col("id").alias("shape")).agg(F.sum("point.n").alias("points"))
    return whole.select("id", "shape").join(narrow(cut(found, "counts")), "shape").select("id", "points")


def areas(polygons: DataFrame) -> DataFrame:
    """(id, area) of polygons (id, rings), holes taken off."""
    each = polygons.select("id", F.aggregate(F.transform(oriented(F.col("rings")), plane.area), F.lit(0.0), lambda a, x: a + x).alias("area"))
    return each.groupBy("id").agg(F.sum("area").alias("area"))


def clipped_shares(a: DataFrame, b: DataFrame, box: tuple[float, float, float, float], depth: int = 4) -> DataFrame:
    """(id, area, inside) of polygons ``a``: their whole area, and that within any part of ``b``, whose polygons don't overlap."""
    met = shared_areas(a, b, box, depth).groupBy(F.col("a").alias("id")).agg(F.sum("area").alias("inside"))
    return matched(areas(a), met, ["id"], "left").select("id", "area", F.coalesce("inside", F.lit(0.0)).alias("inside"))


__all__: Sequence[str] = ("areas", "clipped_shares", "edge_table", "holder_counts", "holders", "neighbours", "shared_areas")
