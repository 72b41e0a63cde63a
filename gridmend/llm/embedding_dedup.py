"""Near duplicates among embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class. A class is scaled to unit length and quantised to int8 once, with its own scale s and
residual norm e = |x - s q|. Classes are dealt into blocks, and each pair of blocks is a tile, which gets the codes
only. The product of two quantised vectors is a whole number that single precision holds exactly (dimensions are summed
in slices that can't exceed 2^24), and

    |x.y - s_x s_y (q_x.q_y)| <= |s_x q_x| e_y + e_x.

Pairs whose upper bound misses the threshold are no links, those whose lower bound reaches it are; a tile counts
these, and names the vectors that have a pair for which neither holds. These alone come to the tile once more, in full
precision, and such pairs are decided in double precision. No pair leaves a tile: it returns one row for each vector
with a link, with how many links and the least class that the tile connects it with.

All pairs are compared, so the work grows with the square of the distinct vectors. Each goes to as many tiles as there
are blocks. Blocks only have to be as many as keep all cores busy and as fit into memory (BLOCK_BYTES of codes), so the
codes that are shuffled grow in proportion to the vectors until blocks are full, and from then on by one int8 code for
each BLOCK_BYTES / dimensions products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, table, written
from .graph import members

#: Bytes of codes in a block at most, classes that a block should have at least, rows and columns of one product,
#: dimensions of one exact slice, and room for rounding.
BLOCK_BYTES, LEAST_BLOCK, ROWS, COLS, SLICE, SLACK = 8 << 20, 1024, 1024, 512, 1024, 1e-9


def levelled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is near 1 and squares neither vanish nor overflow."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, int8 codes, scales, norms of what the codes stand for, and residual norms."""
    x = levelled(x)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    stands = code * scale[:, None]
    return unit, code, scale, np.sqrt((stands * stands).sum(axis=1)), np.sqrt(((unit - stands) ** 2).sum(axis=1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two blocks of codes."""
    total = None
    for k in range(0, a.shape[1], SLICE):
        part = a[:, k : k + SLICE].astype(np.float32) @ b[:, k : k + SLICE].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def join_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins u[i] and v[i] in a forest in which every root is its tree's least member."""
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


class Tile:
    """The codes of a tile, and what is known of its pairs. ``side``: 0 or 1, the block of each row; on the diagonal
    all are 0 and each pair is looked at once. ``count``: vectors of a class."""

    def __init__(self, cls, side, count, code, scale, stands, rest, diagonal: bool) -> None:
        order = np.argsort(cls, kind="stable")
        self.cls, self.side, self.count, self.code, self.scale, self.stands, self.rest = (x[order] for x in (cls, side, count, code, scale, stands, rest))
        self.order, self.diagonal = order, diagonal

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(u, v, certain) by portions: pairs that may reach the threshold, and whether they certainly do."""
        code, scale, stands, rest = self.code, self.scale, self.stands, self.rest
        left = np.flatnonzero(self.side == 0)
        right = left if self.diagonal else np.flatnonzero(self.side == 1)
        right = right[np.argsort(scale[right], kind="stable")]  # columns of one product have nearly one scale
        for i in range(0, len(left), ROWS):
            rows = left[i : i + ROWS]
            for j in range(0, len(right), COLS):
                cols = right[j : j + COLS]
                dots = product(code[rows], code[cols])
                # a bound for all columns at once, then the pair's own
                least = (threshold - SLACK - stands[rows] * rest[cols].max() - rest[rows]) / scale[rows]
                least = np.where(least > 0, least / scale[cols].max(), least / scale[cols].min()) - 1
                r, c = np.nonzero(dots >= least[:, None].astype(dots.dtype))
                u, v = rows[r], cols[c]
                if self.diagonal:
                    once = u < v
                    u, v, r, c = u[once], v[once], r[once], c[once]
                near = dots[r, c].astype(np.float64) * scale[u] * scale[v]
                off = stands[u] * rest[v] + rest[u]
                may = near + off >= threshold - SLACK
                if may.any():
                    yield u[may], v[may], (near - off >= threshold + SLACK)[may]

    def start(self) -> None:
        self.links, self.root = np.zeros(len(self.cls), np.int64), np.arange(len(self.cls))

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        n = len(self.cls)
        self.links += np.bincount(u, self.count[v], n).astype(np.int64) + np.bincount(v, self.count[u], n).astype(np.int64)
        join_roots(self.root, u, v)

    def certain(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, links, least class connected, whether pairs are open) of vectors with a link or an open pair."""
        self.start()
        open_ = np.zeros(len(self.cls), bool)
        for u, v, sure in self.pairs(threshold):
            self.link(u[sure], v[sure])
            open_[u[~sure]] = open_[v[~sure]] = True
        some = (self.links > 0) | open_
        return self.cls[some], self.links[some], self.cls[self.root[some]], open_[some]

    def exact(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, links, least class connected) by the open pairs alone; ``x``: the vectors in the order given."""
        self.start()
        x = levelled(x[self.order])
        norm = np.sqrt((x * x).sum(axis=1))
        for u, v, sure in self.pairs(threshold):
            u, v = u[~sure], v[~sure]
            for k in range(0, len(u), 65_536):
                a, b = u[k : k + 65_536], v[k : k + 65_536]
                linked = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
                self.link(a[linked], b[linked])
        some = self.links > 0
        return self.cls[some], self.links[some], self.cls[self.root[some]]


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _tile(rows: pa.Table) -> Tile:
    get = lambda k: rows.column(k).to_numpy()
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, -1)
    return Tile(get("cls"), get("side"), get("n"), code, get("scale"), get("stands"), get("rest"), bool(get("i")[0] == get("j")[0]))


def coded(classes: DataFrame) -> DataFrame:
    """``classes`` (cls, n, dim, embedding) as (cls, n, dim, code, scale, stands, rest)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                _, code, scale, stands, rest = quantised(_matrix(part.column(3)))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], codes, pa.array(scale), pa.array(stands), pa.array(rest)], names=["cls", "n", "dim", "code", "scale", "stands", "rest"])

    return classes.select("cls", "n", "dim", "embedding").mapInArrow(of, "cls long, n long, dim int, code binary, scale double, stands double, rest double")


def block_count(rows: int, dim: int, cores: int) -> int:
    """As many blocks as make two tiles for each core, unless they get too small or too large for that."""
    busy = min(int((4 * cores) ** 0.5) + 1, max(1, rows // LEAST_BLOCK))
    return max(busy, -(-rows * max(dim, 1) // BLOCK_BYTES), 1)


def link_vectors(vectors: DataFrame, threshold: float = 0.9, blocks: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components, and vectors of different lengths, aren't
    linked. Each repeated row counts as a vector of its own. A null vec_id is never a component's id unless all
    are null; its row isn't kept. An empty table gives an empty result. ``blocks``: how many, if not as many as suit.
    """
    e = F.col("embedding")
    largest = F.array_max(F.transform(e, lambda x: F.abs(x.cast("double"))))  # NaN is larger than all numbers
    sound = F.coalesce(~F.exists(e, F.isnull) & (largest > 0) & (largest < float("inf")), F.lit(False))
    valid = vectors.where(sound).select("vec_id", "embedding")
    classes = valid.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vector-classes")
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    blocks = blocks or block_count(size.n, size.dim, vectors.sparkSession.sparkContext.defaultParallelism)
    codes = written(coded(classes), "vector-codes")

    home = F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int")
    placed = codes.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ends = (F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), (F.col("home") > F.col("other")).cast("int").alias("side"))
    tiles = placed.select("dim", *ends, "cls", "n", "code", "scale", "stands", "rest")

    def sure(rows: pa.Table) -> pa.Table:
        at = {k: rows.column(k)[0].as_py() for k in ("dim", "i", "j")}
        got = _tile(rows).certain(threshold)
        return pa.table({**{k: pa.array(np.full(len(got[0]), x, np.int32)) for k, x in at.items()}, **dict(zip(("cls", "links", "root", "open"), got, strict=True))})

    found = written(tiles.groupBy("dim", "i", "j").applyInArrow(sure, "dim int, i int, j int, cls long, links long, root long, open boolean"), "vector-links")

    def whole(rows: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("cls", "links", "root"), _tile(rows).exact(_matrix(rows.column("embedding")), threshold), strict=True)))

    # a vector comes to a tile in full precision only where one of its pairs is open there
    wanted = found.where("open").select("i", "j", F.col("cls").alias("at"))
    full = codes.join(classes.select("cls", "embedding"), "cls").join(wanted, F.col("cls") == F.col("at"))
    again = full.select("dim", "i", "j", F.when(F.col("i") == F.col("j"), 0).otherwise((home == F.col("j")).cast("int")).alias("side"), "cls", "n", "code", "scale", "stands", "rest", "embedding")
    decided = written(again.groupBy("dim", "i", "j").applyInArrow(whole, "cls long, links long, root long"), "vector-links")

    both = written(found.where("links > 0").select("cls", "links", "root").unionByName(decided), "vector-links")
    erase(codes, found, decided)
    links = both.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = members(both.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "cls", "left").join(roots, classes.cls == roots.node, "left")
    known = known.select("embedding", "first_id", F.col("n"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"))
    # written first: a join of two plain shuffles is one that Spark can split where a root is hot
    ids = written(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "vector-roots")
    known = known.join(ids, "root").select("embedding", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    rows = vectors.select("vec_id", F.when(sound, e).alias("embedding"))
    met = rows.join(known, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return met.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every embedding at cosine 0.9."""
    return link_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
