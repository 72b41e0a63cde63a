"""Interaction audit of filters: what each filter removes under every order, and its Shapley share.

Texts are measured once, into a mask of the filters that they fail; documents are then only counted by mask, so the
orders are walked over 2^n cells for each part, whatever the size of the table. The walk visits all permutations by
single swaps of neighbours: a swap changes what two steps remove, and nothing else, so two steps are read from the
cells again and the sums behind the Shapley values go on from there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import portions, small_batches, table

#: The filters, in the order of their bits: few words, few distinct words, many capitals, symbols, copies.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
#: Texts of more bytes are read word by word, so that they are never held as lists of words.
LONG = 1 << 20
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), SYMBOLS.encode()
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def text_mask(text: str) -> int:
    """Bits 0 to 3: whether a text fails filters A to D."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) > LONG:
        n_words, seen = 0, set()
        for m in _WORD.finditer(raw):
            n_words += 1
            seen.add(m[0])
        n_distinct = len(seen)
    else:
        words = raw.split()  # bytes are split at just the six characters that separate words here
        n_words, n_distinct = len(words), len(set(words))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (n_words < LEAST_WORDS)
        | (100 * n_distinct < LEAST_DISTINCT_PERCENT * n_words) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * len(text)) << 2
        | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3
    )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each row of ``docs`` (doc_id, text, lang). No row is moved."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            texts = [t or "" for t in b.column(2).to_pylist()]
            masks = pa.array([text_mask(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, part string, mask int, digest binary")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of ``docs`` fail just the filters of each mask.

    ``labels`` (doc_id, quality, toxic): a document is good or toxic if any row of its id says so. Rows without an id
    have no labels, are older than no other row and have no older copy. Equal rows are counted one by one, and are no
    copies of each other. Copies are counted without bringing them together: rows are summed by id and text, then by
    text and kind of row, with the least id of each; only these sums of a text meet, at most four for each part.
    """
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = measured(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    rows = rows.join(said, "doc_id", "left").fillna({"good": False, "toxic": False})
    known = F.col("doc_id").isNotNull()
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown")
    )
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    originals = F.col("unknown") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    copies = 1 << FILTERS.index("E")
    split = kinds.withColumn("originals", originals).select(
        "part",
        "good",
        "toxic",
        F.explode(F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + copies).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))).alias("x"),
    )
    count = lambda which: F.sum(F.when(F.col(which), F.col("x.n")).otherwise(0)).alias(which)
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), count("good"), count("toxic"))


def swaps(n: int) -> Iterator[int]:
    """The places i at which neighbours i and i + 1 are swapped, so that from any order of n things all n! are met once.

    The last thing wanders through each order of the others, to and fro; an order of the others changes when it is at an end.
    """
    if n < 2:
        return
    inner, last_in_front = swaps(n - 1), False
    while True:
        yield from range(n - 2, -1, -1) if not last_in_front else range(n - 1)
        last_in_front = not last_in_front
        step = next(inner, None)
        if step is None:
            return
        yield step + last_in_front


def walk(counts: np.ndarray, n: int) -> tuple[list[tuple[list[int], np.ndarray]], np.ndarray]:
    """All orders of ``n`` filters with what each step removes, and what each filter removes in all orders together.

    ``counts`` has a row for each mask, with any number of columns; they are counted alike. The second result is of the
    first column.
    """
    masks = np.arange(1 << n)

    def removed(before: int, f: int) -> np.ndarray:
        return counts[(masks & before == 0) & (masks >> f & 1 == 1)].sum(axis=0)

    order, before = list(range(n)), [(1 << i) - 1 for i in range(n)]
    steps = np.array([removed(b, f) for b, f in zip(before, order, strict=True)])
    now = steps[:, 0].copy()  # by filter: the first order is that of the filters
    orders, total = [(order.copy(), steps.copy())], now.copy()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        for k in (i, i + 1):
            steps[k] = removed(before[k], order[k])
            now[order[k]] = steps[k, 0]
        orders.append((order.copy(), steps.copy()))
        total += now
    return orders, total


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part of ``cells`` (part, mask, n, good, toxic), each order of ``filters`` and each step, what is kept and
    removed there; see op12_filter_audit. A part has at most 2^n cells, which come together in one row."""
    n = len(filters)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = np.zeros((1 << n, 3), np.int64)
                for c in row["cells"]:
                    counts[c["mask"]] += [c["n"], c["good"], c["toxic"]]
                failing = [int(counts[np.arange(1 << n) >> f & 1 == 1, 0].sum()) for f in range(n)]
                orders, total = walk(counts, n)
                out = []
                for order, steps in orders:
                    kept = int(counts[:, 0].sum())
                    for k, f in enumerate(order):
                        kept -= int(steps[k, 0])
                        out.append((row["part"], "".join(filters[x] for x in order), k + 1, kept, int(steps[k, 0]), failing[f] - int(steps[k, 0]), int(counts[1 << f, 0]), int(steps[k, 1]), int(steps[k, 2]), int(total[f])))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    grouped = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return grouped.mapInArrow(walked, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


_NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_TYPES = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over whole texts of all documents, in all 120 orders, for each language.

    Null texts and those without words are short ones (A) and fail nothing else but E; a null language is the empty one.
    See mask_cells for ids that are null or repeated, and for labels. Very long texts are read whole, word by word. An
    empty table gives no rows; other columns are never read.
    """
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return audit(mask_cells(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))
