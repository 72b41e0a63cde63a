"""Near-duplicate documents by ProbMinHash over weighted shingles, banding and exact verification.

A shingle is five consecutive words; its weight is 1 + log2 of how often the text has it. Each shingle is a Poisson
process with its weight as rate, whose arrivals fall on the signature's components at random; a component keeps the
shingle that arrives first. Processes are followed in time order and given up once they are later than all
components' first arrivals. Two signatures then agree in a component with the texts' probability Jaccard. A text that
repeats shingles has a second signature for which all weights are 1; two of these agree with the plain Jaccard. For
other texts both signatures are the same.

Both signatures are banded, with the same keys. Texts that share a band are compared, in two turns:

* each text with one other, the least text of the band that it shares most bands with. This connects most copies, and
  sends each text once;
* bands whose texts still lie in several connected parts are dealt into tiles, blocks of the texts outside the band's
  largest part against all. A tile first gets signatures only and names the texts with a partner that looks similar
  and isn't connected yet; these alone come to it once more as texts, and are verified on their whole shingle sets.

Two texts are linked if their Jaccard similarity, plain or weighted, is at least 0.8. Links that only connect what is
connected already aren't looked for: a tile returns a spanning forest, so what leaves it grows with the texts and not
with their pairs. Exact copies (equal words) are one node throughout. Hot bands and hot texts are dealt over tiles and
parts, and every join on them is one of two plain shuffles, which Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, claim, erase, place_of, portions, small_batches, table, unused, written
from .graph import members

#: Words of a shingle, the similarity, bands and their rows, texts in a block.
WORDS, SIMILARITY, BANDS, BAND_ROWS, BLOCK = 5, 0.8, 28, 5, 256
SIZE = BANDS * BAND_ROWS
#: Pairs whose signatures agree in a smaller share aren't verified: over five standard deviations under 0.8.
LOOKS = SIMILARITY - 5.2 * (SIMILARITY * (1 - SIMILARITY) / SIZE) ** 0.5
#: Shingles that are processed together, and word hashes that a worker keeps.
TOGETHER, CACHE = 100_000, 150_000
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = [np.uint64(pow(0x2545F4914F6CDD1D, k, 2**64)) for k in range(WORDS)]
_hashes: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _hash_word(word: bytes) -> int:
    if len(_hashes) >= CACHE:
        _hashes.clear()
    h = _hashes[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text that has words, and how often each occurs."""
    get = _hashes.get
    w = np.array([get(x) or _hash_word(x) for x in words], np.uint64)
    n = len(w) - WORDS + 1
    if n < 1:  # a shorter text is one shingle
        return mixed(np.array([int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "big")], np.uint64)), np.ones(1, np.int64)
    total = w[:n] * _FACTORS[WORDS - 1]
    for k in range(1, WORDS):
        total = total + w[k : n + k] * _FACTORS[WORDS - 1 - k]
    return np.unique(mixed(total), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log2(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], plain: bool = False) -> np.ndarray:
    """A row of SIZE components (low 32 bits of the winning shingles) for each text; ``plain``: all weights are 1."""
    docs = len(sets)
    doc = np.repeat(np.arange(docs), [len(s) for s, _ in sets])
    element = np.concatenate([s for s, _ in sets])
    pace = np.ones(len(element)) if plain else 1.0 / weights(np.concatenate([c for _, c in sets]))
    first = np.full(docs * SIZE, np.inf)
    won = np.zeros(docs * SIZE, np.uint32)
    time, step = np.zeros(len(element)), 0
    while len(element):
        step += 1
        base = mixed(element + np.uint64(step * int(_GOLD) % 2**64))
        time = time - np.log(((base >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) * pace
        at = doc * SIZE + (mixed(base ^ _B) % np.uint64(SIZE)).astype(np.int64)
        np.minimum.at(first, at, time)
        best = first[at] == time
        won[at[best]] = element[best].astype(np.uint32)
        alive = np.unique(doc)
        latest = np.zeros(docs)
        latest[alive] = first.reshape(docs, SIZE)[alive].max(axis=1)
        on = time < latest[doc]
        element, pace, time, doc = element[on], pace[on], time[on], doc[on]
    return won.reshape(docs, SIZE)


def repeating(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The places of texts that repeat shingles, whose plain signature isn't the weighted one."""
    return np.array([i for i, (_, c) in enumerate(sets) if c.max() > 1], np.int64)


def both_signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted and plain signatures."""
    sig, again = signatures(sets), repeating(sets)
    if not len(again):
        return sig, sig
    plain = sig.copy()
    plain[again] = signatures([sets[i] for i in again], plain=True)
    return sig, plain


def bands(signature: np.ndarray) -> np.ndarray:
    """BANDS keys for each signature."""
    part = signature.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD), part.shape[:2])
    for k in range(BAND_ROWS):
        key = mixed(key + part[:, :, k] * _GOLD + np.uint64(k + 1))
    return key.view(np.int64)


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of plain Jaccard and probability Jaccard."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    if plain >= SIMILARITY or (a[1].max() == 1 and b[1].max() == 1):
        return plain
    wa, wb = weights(a[1]), weights(b[1])
    # a shared shingle adds 1 / (sum over all shingles of max(wa'/wa, wb'/wb)); shingles are taken in the order of
    # wa/wb, so that those before it count by b's weights, and it and those after it by a's
    only_a, only_b = np.delete(wa, i).sum(), np.delete(wb, j).sum()
    order = np.argsort(wa[i] / wb[j], kind="stable")
    x, y = wa[i][order], wb[j][order]
    below_b = np.concatenate(([0.0], np.cumsum(y)[:-1]))
    from_a = x.sum() - np.concatenate(([0.0], np.cumsum(x)[:-1]))
    return max(plain, float((1.0 / ((only_a + from_a) / x + (only_b + below_b) / y)).sum()))


def digest(words: list[bytes]) -> bytes | None:
    return hashlib.md5(b" ".join(words)).digest() if words else None


def place(key: bytes) -> int:
    """The first eight bytes of a digest as a number in the same order as the digests, so that the text with the least
    number is the least text too."""
    return int.from_bytes(key[:8], "big") - (1 << 63)


def _row_key(doc_id: object, text_key: bytes | None) -> bytes:
    return hashlib.md5(repr(doc_id).encode() + b"\n" + (text_key or b"")).digest()


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at, key, bands): a digest of the words, its place, a digest of the row, and the band keys, which only
    the first of a task's equal texts has. Texts without words have neither h nor bands."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _hashes.clear)
        seen: set[bytes] = set()
        for b in portions(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys: list[bytes | None] = []
            found: list[list[int] | None] = [None] * len(ids)
            sets, places, size = [], [], 0

            def flush() -> None:
                if sets:
                    sig, plain = both_signatures(sets)
                    for at, row in zip(places, bands(sig).tolist(), strict=True):
                        found[at] = row
                    again = repeating(sets)
                    for i, row in zip(again.tolist(), bands(plain[again]).tolist(), strict=True):
                        found[places[i]] = list({*found[places[i]], *row})
                    sets.clear(), places.clear()

            for at, t in enumerate(texts):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                keys.append(h := digest(words))
                if h is not None and h not in seen:
                    seen.add(h)
                    sets.append(shingles(words))
                    places.append(at)
                    size += len(sets[-1][0])
                    if size >= TOGETHER:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array([None if h is None else place(h) for h in keys], pa.int64()), pa.array([_row_key(i, h) for i, h in zip(ids, keys, strict=True)], pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "h", "at", "key", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, h binary, at long, key binary, bands array<long>")


def shared_bands(marked: DataFrame) -> DataFrame:
    """(band, h, at, lead) of the texts that share a band with others; lead is the least place in the band."""
    keyed = marked.where("bands is not null").select("h", "at", F.explode("bands").alias("band"))
    # combined before the shuffle, and written, so that the join is one of two plain shuffles
    lead = keyed.groupBy("band").agg(F.min("at").alias("lead"), F.max("at").alias("last"))
    lead = written(lead.where("lead <> last").select(F.col("band").alias("of"), "lead"), "near-leads")
    found = written(keyed.join(lead, keyed.band == lead.of).select("band", "h", "at", "lead").distinct(), "near-bands")
    erase(lead)
    return found


def texts_of(docs: DataFrame) -> DataFrame:
    """(h, at, text): in each task, the first text with each digest, and its place."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in portions(batches):
            keys = [digest((t or "").encode("utf-8", "surrogatepass").split()) for t in b.column(0).to_pylist()]
            new = [h is not None and h not in seen and not seen.add(h) for h in keys]
            places = pa.array([None if h is None else place(h) for h in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), places, b.column(0)], names=["h", "at", "text"]).filter(pa.array(new, pa.bool_()))

    return docs.select("text").mapInArrow(of, "h binary, at long, text string")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows that come sorted by their first ``keys`` columns, as (key, the other columns) for each key."""
    now, held = None, []
    for b in portions(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, [list(c) for c in zip(*held, strict=True)]
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, [list(c) for c in zip(*held, strict=True)]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def star_links(near: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """(a, b): each text with the lead of the band that it shares most bands with, where they are similar."""
    shared = near.where("at <> lead").groupBy("h", "lead").count()
    best = written(shared.groupBy("h").agg(F.max(F.struct("count", "lead")).alias("x")).select(F.col("h").alias("of"), "x.lead"), "near-stars")
    sizes = written(best.groupBy(F.col("lead").alias("to")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "near-sizes")
    part = F.pmod(F.xxhash64("of", F.lit("part")), F.col("parts")).cast("int")
    met = best.join(sizes, F.col("lead") == F.col("to")).select("of", "lead", part.alias("part"))
    members = met.join(texts, F.col("of") == F.col("h")).select("lead", "part", F.lit(1).alias("side"), "h", "text")
    leads = texts.join(sizes, F.col("at") == F.col("to")).select(F.col("to").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "h", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _hashes.clear)
        for _, (side, keys, said) in grouped(batches, 2):
            sets = [shingles(words_of(t)) for t in said]
            leads = [i for i, x in enumerate(side) if x == 0]
            found = [(keys[i], keys[j]) for i, x in enumerate(side) if x == 1 for j in leads if similar(sets[i], sets[j]) >= SIMILARITY]
            if found:
                yield _edges(found)

    made = written(dealt(members.unionByName(leads), "lead", "part").mapInArrow(of, "a binary, b binary"), "near-links")
    erase(best, sizes)
    return made


def signed(texts: DataFrame) -> DataFrame:
    """(h, sig, plain) of (h, text); plain is null where it is the same."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _hashes.clear)
        for b in portions(batches):
            sig, plain, again = signatures_of([shingles(words_of(t)) for t in b.column(1).to_pylist()])
            rows = [plain[i].tobytes() if again[i] else None for i in range(len(sig))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(rows, pa.binary())], names=["h", "sig", "plain"])

    return texts.select("h", "text").mapInArrow(of, "h binary, sig binary, plain binary")


def signatures_of(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted and plain signatures, and where they differ, by portions of bounded size."""
    parts, start = [], 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end][0]) <= TOGETHER):
            size += len(sets[end][0])
            end += 1
        parts.append(both_signatures(sets[start:end]))
        start = end
    again = np.zeros(len(sets), bool)
    again[repeating(sets)] = True
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), again


def alike(sig: np.ndarray, plain: np.ndarray, again: np.ndarray, side: np.ndarray, part: np.ndarray, one: bool, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, share) of the pairs of a tile that look similar, lie in different parts, and have ``band`` as the least of
    the bands that they share, so that a pair is looked at once; ``one``: the tile is a block with itself."""
    keys = (bands(sig), bands(plain))
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for i in range(0, len(left), 32):
        rows = left[i : i + 32]
        share = (sig[rows][:, None, :] == sig[right][None, :, :]).mean(axis=2)
        r, c = np.flatnonzero(again[rows]), np.flatnonzero(again[right])
        if len(r):
            share[r] = np.maximum(share[r], (plain[rows[r]][:, None, :] == plain[right][None, :, :]).mean(axis=2))
        if len(c):
            share[:, c] = np.maximum(share[:, c], (plain[rows][:, None, :] == plain[right[c]][None, :, :]).mean(axis=2))
        r, c = np.nonzero(share >= LOOKS)
        u, v, s = rows[r], right[c], share[r, c]
        keep = part[u] != part[v]
        if one:
            keep &= u < v
        u, v, s = u[keep], v[keep], s[keep]
        first = np.full(len(u), np.iinfo(np.int64).max)
        for a in keys:
            for b in keys:
                first = np.minimum(first, np.where(a[u] == b[v], a[u], first[:, None]).min(axis=1))
        found.append((u[first == band], v[first == band], s[first == band]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def unpacked(sig: list[bytes], plain: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted and plain signatures as arrays, and where they differ."""
    both = [np.frombuffer(b"".join(x), np.uint32).reshape(len(sig), SIZE) for x in (sig, [p or s for p, s in zip(plain, sig, strict=True)])]
    return both[0], both[1], np.array([x is not None for x in plain])


def tile_links(keys: list[bytes], side: np.ndarray, part: np.ndarray, sig: list[bytes], plain: list[bytes | None], texts: list[str], one: bool, band: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links of a tile between what isn't connected yet."""
    u, v, share = alike(*unpacked(sig, plain), side, part, one, band)
    sets = [shingles(words_of(t)) for t in texts]
    order = np.argsort(-share, kind="stable")
    root, found = list(range(int(part.max()) + 1)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(u[order].tolist(), v[order].tolist(), strict=True):
        x, y = top(part[a]), top(part[b])
        if x != y and similar(sets[a], sets[b]) >= SIMILARITY:
            root[max(x, y)] = min(x, y)
            found.append((keys[a], keys[b]))
    return found


def tile_rows(near: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """(band, kind, i, j, side, h, part) of the bands whose texts lie in several parts (node, root). Kind 0: blocks
    outside the band's largest part with each other; kind 1: such a block i with block j of that part."""
    rows = near.select("band", "h").join(parts, F.col("h") == F.col("node"), "left").select("band", "h", F.coalesce("root", "h").alias("part"))
    counts = rows.groupBy("band", "part").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(F.col("band").alias("at")).agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("total")).where("main.n < total")
    open_ = written(sizes.select("at", F.col("main.part").alias("main"), F.ceil((F.col("total") - F.col("main.n")) / block).cast("int").alias("apart"), F.ceil(F.col("main.n") / block).cast("int").alias("whole")), "near-open")
    stray = F.col("part") != F.col("main")
    placed = rows.join(open_, F.col("band") == F.col("at")).withColumn("x", F.pmod(F.xxhash64("h", F.lit("block")), F.when(stray, F.col("apart")).otherwise(F.col("whole"))).cast("int"))
    tile = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    x = F.col("x")
    among = F.transform(upto("apart"), lambda y: tile(0, F.least(x, y), F.greatest(x, y), x > y))
    across = F.transform(upto("whole"), lambda y: tile(1, x, y, F.lit(0)))
    back = F.transform(upto("apart"), lambda y: tile(1, y, x, F.lit(1)))
    return placed.select("band", "h", "part", F.explode(F.when(stray, F.concat(among, across)).otherwise(back)).alias("t")).select("band", "t.*", "h", "part")


def tiled_links(near: DataFrame, texts: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """(a, b): verified links that connect what is similar within each band and isn't connected yet."""
    rows = written(tile_rows(near, parts, block), "near-tiles")
    some = rows.select(F.col("h").alias("of")).distinct()
    prints_ = written(signed(texts.join(some, F.col("h") == F.col("of"), "left_semi")), "near-signatures")
    marked = rows.join(prints_.withColumnRenamed("h", "of"), F.col("h") == F.col("of")).select("band", "kind", "i", "j", "side", "h", "part", "sig", "plain")

    def numbered(part: list[bytes]) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(x, len(known)) for x in part])

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, kind, i, j), (side, keys, part, sig, plain) in grouped(batches, 4):
            u, v, _ = alike(*unpacked(sig, plain), np.array(side), numbered(part), kind == 0 and i == j, band)
            at = np.unique(np.concatenate([u, v])).tolist()
            if at:
                out = [[band] * len(at), [kind] * len(at), [i] * len(at), [j] * len(at), [side[k] for k in at], *([c[k] for k in at] for c in (keys, part, sig, plain))]
                kinds = (pa.int64(), *[pa.int32()] * 4, *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["band", "kind", "i", "j", "side", "of", "part", "sig", "plain"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _hashes.clear)
        for (band, kind, i, j), (side, keys, part, sig, plain, said) in grouped(batches, 4):
            found = tile_links(keys, np.array(side), numbered(part), sig, plain, said, kind == 0 and i == j, band)
            if found:
                yield _edges(found)

    open_ = written(dealt(marked, "band", "kind", "i", "j").mapInArrow(looks, "band long, kind int, i int, j int, side int, of binary, part binary, sig binary, plain binary"), "near-looks")
    whole = open_.join(texts, F.col("h") == F.col("of")).select("band", "kind", "i", "j", "side", "h", "part", "sig", "plain", "text")
    made = written(dealt(whole, "band", "kind", "i", "j").mapInArrow(verify, "a binary, b binary"), "near-links")
    erase(rows, prints_, open_)
    return made


def links(docs: DataFrame, marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links that connect all texts that share a band and are similar, or are connected by such."""
    near = shared_bands(marked)
    some = near.select(F.col("h").alias("of")).distinct()
    # texts are far larger than the ids of those in question, however few these are: the plan is the same at every size
    texts = written(texts_of(docs).join(some.hint("merge"), F.col("h") == F.col("of"), "left_semi").dropDuplicates(["h"]), "near-texts")
    first = star_links(near, texts, block)
    parts = written(members(first), "near-parts")
    both = written(first.unionByName(tiled_links(near, texts, parts, block)), "near-links")
    erase(near, texts, first, parts)
    return both


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_id) for each row of ``docs`` (doc_id, text): class_id is the least doc_id of the row's class.

    Texts without words, null ones included, are classes of their own. Repeated rows fall into one class. Null ids
    don't give a class its id unless it has no other. Very long texts are compared whole; an empty table gives an empty
    result.
    """
    marked = written(prints(docs), "prints")
    found = links(docs, marked, BLOCK)
    roots = members(found)
    firsts = marked.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("first_id"))
    firsts = written(firsts.join(roots, firsts.h == roots.node, "left").select("h", "first_id", F.coalesce("root", "h").alias("root")), "near-firsts")
    least = firsts.groupBy(F.col("root").alias("at")).agg(F.min("first_id").alias("class_id"), F.count("*").alias("texts"))
    least = written(least.where("texts > 1").drop("texts"), "near-classes")
    known = firsts.join(least, firsts.root == least.at, "left").select("h", F.when(F.col("at").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"))
    return marked.select("doc_id", "h", "key").join(known, "h", "left").select("doc_id", "key", F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, columns unchanged: that with the least doc_id, once if it is repeated. Columns
    of any other name are carried along; odd rows are treated as in near_duplicates."""
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("key").distinct()
    own = unused(docs, "gm_key")
    at = (place_of(docs.columns, "doc_id"), place_of(docs.columns, "text"))

    def keyed(b: pa.RecordBatch) -> pa.Array:
        hs = [digest((t or "").encode("utf-8", "surrogatepass").split()) for t in b.column(at[1]).to_pylist()]
        return pa.array([_row_key(i, h) for i, h in zip(b.column(at[0]).to_pylist(), hs, strict=True)], pa.binary())

    rows = appended(docs, own, lambda: keyed, F.lit(b""))
    return rows.join(kept, rows[own] == kept.key, "left_semi").dropDuplicates([own]).drop(own)


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document with the id of its near-duplicate class; kept is true for the one that stands for the class. See
    near_duplicates() for odd rows."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))
