"""Token ids as raw binary files, with a minimal perfect hash index over the documents in them.

A folder of token files holds:

* ``files/kind=ids``: the ids of documents in ascending order of doc_id, each document closed by the end id, one
  fixed width and nothing else. Spark's text sink writes them with the end id as its line separator, so they come
  into any store that Spark writes to, by the same commit, and a lost task leaves nothing behind.
* ``files/kind=docs``: for each of these files one record for each document (doc_id, ids).
* ``index``: rows of hash functions and records. A key (doc_id, copy) goes by its hash to one of the rows, there by a
  minimal perfect hash to one record, and the record has a fingerprint of the key, the file and the place in it.
* ``format``: width, end id, digest of the tokenizer.

A file is a shard: part number x 65,536 + number within the part. It has SHARD_IDS ids at most, or one document.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import claim, portions, scratch, small_batches, table
from .token_counts import PLAIN

#: Closes each document. Its bytes have to be below 0x80, as text they are the sink's line separator.
END_ID = 2
#: Ids of a file at most; keys of an index row, about; words that a worker remembers.
SHARD_IDS, ROW_KEYS, CACHE_WORDS = 8 << 20, 50_000, 600_000
#: Bits of a level of the hash for each key that is left, and levels before what is left is listed.
LEVEL_BITS, LEVELS = 2, 24
#: The pre-token pattern of the tokenizer with word ends, a fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Punctuation that often follows a word; a run of it is one pre-token.
STOPS = ".,;:!?"
#: Byte-level letters: printable bytes stand for themselves, the others for letters from U+0100 on, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
RECORD = np.dtype([("print", "<u4"), ("n", "<u4"), ("shard", "<i8"), ("at", "<i8"), ("start", "<i8")])


class WordIds:
    """Encodes as the library does. One for each tokenizer file in a worker."""

    made: dict[str, WordIds] = {}

    def __init__(self, file: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        known = json.loads(file)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.letter, self.model = "H" if self.width == 2 else "I", self.whole.model
        added = known.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        suffix = known["model"].get("end_of_word_suffix")
        steps = [n.get("type") for n in (known.get("normalizer") or {}).get("normalizers", [])]
        split = ((known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        #: Words can be encoded one by one with this kind of tokenizer only; others encode whole texts.
        self.splits = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": PRE_TOKEN} and split.get("invert") is True
        self.splits = self.splits and not known.get("post_processor") and not known["model"].get("dropout")
        self.plain, self.pre_tokens = re.compile(PLAIN).fullmatch, regex.compile(PRE_TOKEN).findall
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # the ids that end a pre-token
        for word, i in vocab.items():
            self.closes[i] = bool(suffix) and word.endswith(suffix)
        self.cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, file: str) -> WordIds:
        claim(__name__, cls.made.clear)
        key = hashlib.sha256(file.encode()).hexdigest()
        if key not in cls.made:
            cls.made[key] = cls(file)
        return cls.made[key]

    def library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)  # without offsets

    def raw(self, ids: np.ndarray) -> bytes:
        return ids.astype(f"<u{self.width}").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words that the cache hasn't. A word of letters with stops after it is two pre-tokens, and both are often
        known or needed again."""
        cut = {w: (stem, w[len(stem) :]) for w in words if (stem := w.rstrip(STOPS)) != w and stem.isalpha()}
        parts = dict.fromkeys(p for w in words for p in cut.get(w, (w,)))
        self.encode_words([p for p in parts if p not in self.cache])
        for w, (stem, stops) in cut.items():
            self.cache[w] = self.cache[stem] + self.cache[stops]

    def encode_words(self, words: list[str]) -> None:
        """Encodes words of letters by the library's model, others by the whole tokenizer in one call each 256; where one of these ends
        is known from the pre-tokens it has."""
        rest = []
        for w in words:
            if w.isalpha():  # one pre-token, which needs no normaliser any more
                ids = [t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(LETTERS))]
                self.cache[w] = struct.pack(f"<{len(ids)}{self.letter}", *ids)
            else:
                rest.append(w)
        words = rest
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            ids = self.library(" ".join(some))
            ends = np.flatnonzero(self.closes[ids]) + 1
            last = np.cumsum([1 if w.isalpha() else len(self.pre_tokens(w)) for w in some])
            if last[-1] != len(ends) or ends[-1] != len(ids):
                self.cache.update((w, self.raw(self.library(w))) for w in some)
                continue
            raw, upto = self.raw(ids), [0, *(ends[last - 1] * self.width).tolist()]
            self.cache.update((w, raw[upto[k] : upto[k + 1]]) for k, w in enumerate(some))

    def encode(self, text: str) -> bytes:
        """The raw ids of ``text``, without an end id."""
        if not self.splits or not self.plain(text) or any(s in text for s in self.special):
            return self.raw(self.library(text))
        words = text.lower().split()
        found = list(map(self.cache.get, words))
        if None not in found:
            return b"".join(found)
        missing = dict.fromkeys(w for w, ids in zip(words, found, strict=True) if ids is None)
        if len(self.cache) >= CACHE_WORDS:  # the words that were met first are the frequent ones, by and large
            self.cache = dict(islice(self.cache.items(), CACHE_WORDS // 3))
            missing = dict.fromkeys(w for w in words if w not in self.cache)
        self.learn(list(missing))
        return b"".join(map(self.cache.__getitem__, words))


def read_tokenizer(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _doc_record(width: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("unknown", "u1"), ("pad", "u1"), ("end", "u1", width)])


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to ``folder``, which must not exist.

    Null texts are empty and have the end id alone. A null doc_id comes first; rows of one doc_id are in the order of
    their texts' xxhash64, and equal rows are written one by one. Texts are moved once, to ranges of doc_id that even
    copies of one row can be dealt into; a task streams its range through the encoder and the sort that the sink needs.
    """
    spark, file = docs.sparkSession, read_tokenizer(tokenizer)
    width = WordIds(file).width
    end = end_id.to_bytes(width, "little")
    if max(end) > 0x7F:
        raise ValueError(f"end id {end_id} has a byte above 0x7f")
    content = spark.sparkContext.broadcast(file)
    dtype = _doc_record(width)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, chunk, filled, seq = WordIds.of(content.value), 0, 0, 0
        for b in portions(batches):
            made = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = codec.encode(text) if text else b""
                n = len(ids) // width + 1
                if filled and filled + n > shard_ids:
                    chunk, filled = chunk + 1, 0
                filled += n
                record = np.zeros(1, dtype)
                record["doc_id"], record["n"], record["unknown"] = doc_id or 0, n, doc_id is None
                made += [("ids", chunk, seq, ids), ("docs", chunk, seq, record.tobytes()[:-width])]
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["kind", "chunk", "seq", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("salt")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, or few bytes would be encoded in few tasks
    rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    made = rows.mapInArrow(encode, "kind string, chunk int, seq long, value binary").sortWithinPartitions("kind", "chunk", "seq")
    made.select("kind", "chunk", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "chunk").option("lineSep", end.decode("ascii")).text(f"{folder}/files")
    about = [(width, end_id, hashlib.sha256(file.encode()).hexdigest())]
    spark.createDataFrame(about, "width int, end_id int, tokenizer string").coalesce(1).write.json(f"{folder}/format")


def _width(spark: SparkSession, folder: str) -> int:
    return spark.read.schema("width int").json(f"{folder}/format").first().width


def shards(spark: SparkSession, folder: str, kind: str, *columns: str) -> DataFrame:
    """(shard, path and ``columns``) of the files of one kind."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/files")
    if "kind" not in found.columns:  # nothing was written
        return spark.createDataFrame([], "shard long, path string, length long, content binary").select("shard", "path", *columns)
    number = F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("long") * 65_536 + F.col("chunk")
    return found.where(F.col("kind") == kind).select(number.alias("shard"), "path", *columns)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, copy, shard, at, n, start) of each document in the files: ``copy`` counts the rows of one doc_id from 0,
    ``at`` and ``start`` are the ids before it in its file and in all files. Only the small files are read, and of these
    one row each, or two, is brought into an order."""
    dtype = _doc_record(_width(spark, folder))
    small = shards(spark, folder, "docs", "content").drop("path")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype)
                ids = [None if u else int(i) for i, u in zip(x["doc_id"][[0, -1]], x["unknown"][[0, -1]], strict=True)]
                same = [int(((x["doc_id"] == (i or 0)) & (x["unknown"] == (i is None))).sum()) for i in ids]
                total = int(x["n"].sum(dtype=np.int64))
                out += [(shard, total, True, ids[0], same[0])] + [(shard, 0, False, ids[1], same[1])] * (ids[0] != ids[1])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["shard", "ids", "opens", "doc_id", "rows"])

    edges = small.mapInArrow(summed, "shard long, ids long, opens boolean, doc_id long, rows long")
    upto = lambda w: w.orderBy("shard", F.desc("opens")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.withColumn("earlier", F.coalesce(F.sum("rows").over(upto(W.partitionBy("doc_id"))), F.lit(0))).where("opens")
    bases = edges.select("shard", "earlier", F.coalesce(F.sum("ids").over(upto(W.partitionBy())), F.lit(0)).alias("base"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw, earlier, base in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype)
                at = np.cumsum(x["n"], dtype=np.int64) - x["n"]
                new = np.ones(len(x), bool)
                new[1:] = (x["doc_id"][1:] != x["doc_id"][:-1]) | (x["unknown"][1:] != x["unknown"][:-1])
                place = np.arange(len(x))
                copy = place - np.maximum.accumulate(np.where(new, place, 0))
                first = int(new[1:].argmax()) + 1 if new[1:].any() else len(x)
                copy[:first] += earlier
                ids = pa.array(x["doc_id"], mask=x["unknown"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(copy), pa.array(np.full(len(x), shard)), pa.array(at), pa.array(x["n"].astype(np.int64)), pa.array(at + base)], names=["doc_id", "copy", "shard", "at", "n", "start"])

    return small.join(bases, "shard").select("shard", "content", "earlier", "base").mapInArrow(listed, "doc_id long, copy long, shard long, at long, n long, start long")


# the hash


def mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """One of a family of 64-bit hashes of 64-bit values."""
    x = h ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mixed(h, 1000) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of the values ``h``: (bit words, words of each level, slot of each value, values left).

    At each level, values that have a bit for themselves set it; the others go on to the next. A slot is the rank of a
    bit. Values that no level tells apart, such as equal ones, get the last slots and have to be listed.
    """
    left, words, sizes, place = np.arange(len(h)), [], [], np.zeros(len(h), np.int64)
    base = 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-len(left) * LEVEL_BITS // 64)
        pos = (mixed(h[left], level) % np.uint64(size * 64)).astype(np.int64)
        alone = np.bincount(pos, minlength=size * 64)[pos] == 1
        bits = np.zeros(size * 64, np.uint8)
        bits[pos[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        place[left[alone]] = pos[alone] + base * 64
        sizes.append(size)
        base += size
        left = left[~alone]
    all_words = np.concatenate(words) if words else np.zeros(0, "<u8")
    slot = ranks(all_words, place)
    slot[left] = len(h) - len(left) + np.arange(len(left))
    return all_words, sizes, slot, left


def ranks(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many bits are set before each place."""
    upto = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    word, bit = place >> 6, (place & 63).astype(np.uint64)
    if not len(words):
        return np.zeros(len(place), np.int64)
    return upto[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


def slots(h: np.ndarray, words: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The slot of each value that the hash was made for; of any other value some slot or -1."""
    place, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        pos = (mixed(h[left], level) % np.uint64(size * 64)).astype(np.int64) + base * 64
        hit = words[pos >> 6] >> (pos & 63).astype(np.uint64) & np.uint64(1) == 1
        place[left[hit]] = pos[hit]
        base += size
        left = left[~hit]
    return np.where(place < 0, -1, ranks(words, np.maximum(place, 0)))


_INDEX = "row int, keys long, words binary, sizes array<int>, records binary, listed_ids array<long>, listed_copies array<long>"


def _hashed(keys: DataFrame, n_rows: int) -> DataFrame:
    h = F.xxhash64("doc_id", "copy")
    return keys.withColumn("h", h).withColumn("row", F.pmod(F.xxhash64(F.col("h")), F.lit(n_rows)).cast("int"))


def build_index(spark: SparkSession, folder: str, row_keys: int = ROW_KEYS) -> None:
    """Makes ``folder``/index from the small files. An index row is built in one task, from about ``row_keys`` keys."""
    found = entries(spark, folder)
    n_rows = max(1, -(-found.count() // row_keys))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        h = group["h"].to_numpy().astype(np.uint64)
        words, sizes, slot, left = perfect_hash(h)
        records = np.zeros(len(h), RECORD)
        records["print"][slot] = fingerprint(h)
        for name in ("n", "shard", "at", "start"):
            records[name][slot] = group[name].to_numpy()
        listed = group.iloc[left]
        ids = [[None if pd.isna(i) else int(i) for i in listed["doc_id"]]]
        return pd.DataFrame({"row": [int(group["row"].iloc[0])], "keys": [len(h)], "words": [words.tobytes()], "sizes": [sizes], "records": [records.tobytes()], "listed_ids": ids, "listed_copies": [listed["copy"].tolist()]})

    # a null among the ids would make pandas take them as doubles
    keys = _hashed(found, n_rows).withColumn("doc_id", F.col("doc_id").cast("string"))
    keys.groupBy("row").applyInPandas(build, _INDEX).write.option("parquet.block.size", 32 << 20).parquet(f"{folder}/index")


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, at, n, start) of those ``keys`` (doc_id, copy) that are there.

    Keys that aren't there are found out by their fingerprint, all but one in 2^32. Keys are looked up once each. A
    task holds one row of the index and the keys that go there.
    """
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    n_rows = index.agg(F.max("row")).first()[0]
    if n_rows is None:
        return spark.createDataFrame([], "doc_id long, copy long, shard long, at long, n long, start long")

    def find(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = asked[["doc_id", "copy"]].copy()
        if not len(asked) or not len(rows):
            return out.iloc[:0].assign(shard=0, at=0, n=0, start=0)
        row = rows.iloc[0]
        h = asked["h"].to_numpy().astype(np.uint64)
        records = np.frombuffer(row["records"], RECORD)
        slot = slots(h, np.frombuffer(row["words"], "<u8"), [int(s) for s in row["sizes"]])
        listed = {(i, c): len(records) - len(row["listed_copies"]) + k for k, (i, c) in enumerate(zip(map(_text, row["listed_ids"]), row["listed_copies"], strict=True))}
        if listed:
            slot = np.array([listed.get(key, s) for key, s in zip(zip(map(_text, asked["doc_id"]), asked["copy"], strict=True), slot, strict=True)])
        there = slot >= 0
        there[there] = records["print"][slot[there]] == fingerprint(h[there])
        hit = records[slot[there]]
        return out[there].assign(**{name: hit[name].astype(np.int64) for name in ("shard", "at", "n", "start")})

    asked = _hashed(keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy")).distinct(), n_rows + 1)
    asked = asked.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = asked.groupBy("row").cogroup(index.groupBy("row")).applyInPandas(find, "doc_id string, copy long, shard long, at long, n long, start long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _text(i) -> str | None:
    return None if pd.isna(i) else str(int(i))


def _opened(path: str):
    """A file of the shared folder, for reading at any place."""
    fs, at = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.open_input_file(at)


def read_ids(spark: SparkSession, folder: str, found: DataFrame, ranged: bool | None = None) -> DataFrame:
    """``found`` (what lookup gives) with ``ids``, the raw ids of each document as little-endian unsigned 32-bit integers.

    Where Arrow knows the file system, a task opens the files of its rows and reads at the places of the documents;
    elsewhere Spark reads the files whole and brings them to their rows.
    """
    width = _width(spark, folder)
    if ranged is None:
        try:
            pafs.FileSystem.from_uri(folder)
            ranged = True
        except (pa.ArrowInvalid, OSError, ImportError):
            ranged = False

    def wide(raw: bytes) -> bytes:
        return np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()

    names = ["doc_id", "copy", "shard", "at", "n", "start", "ids"]
    schema = "doc_id long, copy long, shard long, at long, n long, start long, ids binary"
    files = shards(spark, folder, "ids", *([] if ranged else ["content"]))
    rows = found.select(*names[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for b in portions(batches):
            got = []
            for at, n, path in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(6).to_pylist(), strict=True):
                if path != name:
                    if opened:
                        opened.close()
                    name, opened = path, _opened(path)
                got.append(wide(opened.read_at(n * width, at * width)))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(got, pa.binary())], names=names)
        if opened:
            opened.close()

    def cut(places: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
        raw = file["content"].iloc[0] if len(file) else b""
        ids = [wide(raw[a * width : (a + n) * width]) for a, n in zip(places["at"], places["n"], strict=True)]
        return places.assign(ids=ids)[names]

    if ranged:
        # found rows have about 150 bytes with their path, and a file's rows come together, in its order
        return rows.join(files, "shard").select(*rows.columns, "path").repartition("shard").sortWithinPartitions("shard", "at").mapInArrow(read, schema)
    as_text = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    whole = as_text.groupBy("shard").cogroup(files.groupBy("shard")).applyInPandas(cut, schema.replace("doc_id long", "doc_id string"))
    return whole.withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_token_index(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, written, indexed, looked up by key and read back.

    See write_ids for null and empty texts, null and repeated ids and equal rows, each of which is a document of its
    own. Very long texts are encoded whole, and one that exceeds a file has a file to itself. An empty table gives no
    rows; other columns are never read. The files stay until common.clear(spark), since the result reads them.
    """
    small_batches(spark)
    folder = scratch(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents", "doc_id", "text"), folder)
    build_index(spark, folder)
    found = lookup(spark, folder, entries(spark, folder).select("doc_id", "copy"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            crc = [zlib.crc32(i) for i in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    read = read_ids(spark, folder, found).select("doc_id", "start", F.col("n").alias("n_tokens"), "ids")
    return read.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
