"""Token counts by a two-tier lookup on the map side.

A compact table of frequent pre-tokens and how many tokens each makes is broadcast; what it hasn't is encoded once
by each worker and kept in a bounded cache. No pre-token leaves its task. The table is only a head start: whatever
rows it was built from, the counts are those of the library.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, claim, place_of, portions, small_batches, table, without

#: Rows that the head-start table is built from, about; entries that it holds; entries of a worker's cache.
SAMPLE_ROWS, TABLE_ENTRIES, CACHE_ENTRIES = 4_000, 50_000, 300_000
#: Texts beyond these characters go to the library whole, so that no difference between two versions of the Unicode
#: tables, or between two ideas of white space, can matter.
PLAIN = r"[\t\n\r\x20-\x7e¡-¬®-ɏΑ-ΡΣ-ωА-я‐-‧€一-龥]*"
#: The pre-token pattern of byte-level BPE, a fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Counts tokens as the library does. One for each tokenizer file in a worker."""

    made: dict[str, TokenCounter] = {}

    def __init__(self, file: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        known = json.loads(file)
        self.special = [t["content"] for t in known.get("added_tokens", [])]
        pre = known.get("pre_tokenizer") or {}
        #: Splitting in Python is known to be right for one kind of tokenizer only; the others count whole texts.
        self.splits = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not known.get("normalizer")
        self.plain, self.pre_token = regex.compile(PLAIN).fullmatch, regex.compile(PRE_TOKEN).findall
        self.cache: dict[str, int] = {}

    @classmethod
    def of(cls, file: str) -> TokenCounter:
        claim(__name__, cls.made.clear)
        key = hashlib.sha256(file.encode()).hexdigest()
        if key not in cls.made:
            cls.made[key] = cls(file)
        return cls.made[key]

    def encode(self, text: str) -> int:
        return len(self.whole.encode(text, add_special_tokens=False).ids)

    def pre_tokens(self, text: str) -> list[str] | None:
        if not self.splits or not self.plain(text) or any(s in text for s in self.special):
            return None
        return self.pre_token(text)

    def count(self, text: str, frequent: dict[str, int]) -> int:
        parts = self.pre_tokens(text)
        if parts is None:
            return self.encode(text)
        cache, n = self.cache, 0
        for p, times in Counter(parts).items() if len(parts) > 64 else ((p, 1) for p in parts):
            k = frequent.get(p)
            if k is None:
                k = cache.get(p)
                if k is None:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    k = cache[p] = self.encode(p)
            n += k * times
        return n


def read_tokenizer(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def frequent_table(texts: DataFrame, file: str, rows: int, seed: int = 7) -> dict[str, int]:
    """Up to TABLE_ENTRIES frequent pre-tokens of about ``rows`` sampled texts, with their token counts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = TokenCounter.of(file), Counter()
        for b in portions(batches):
            for t in b.column(0).to_pylist():
                seen.update(counter.pre_tokens(t or "") or ())
        top = seen.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_pydict({"part": [p for p, _ in top], "times": [n for _, n in top], "size": [counter.encode(p) for p, _ in top]}, pa.schema([("part", pa.string()), ("times", pa.int64()), ("size", pa.int32())]))

    total = texts.count()  # from the file's footers
    if not total:
        return {}
    sample = texts.sample(min(1.0, rows / total), seed).mapInArrow(tally, "part string, times long, size int")
    best = sample.groupBy("part", "size").agg(F.sum("times").alias("times")).where("times > 1").orderBy(F.desc("times"), "part").limit(TABLE_ENTRIES)
    return {r.part: r.size for r in best.select("part", F.col("size")).collect()}


def count_tokens(docs: DataFrame, tokenizer: str | None = None, out: str = "n_tokens", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (text and any others) with the tokens of each whole text; null and empty texts have none, very long ones
    are counted whole, repeated rows are counted alike, and an empty table gives an empty one.

    ``tokenizer``: path of a tokenizers file that the driver reads; its content goes with the tasks. Special
    strings inside texts are special tokens, as is the library's default. A column named ``out`` is replaced.
    """
    file = read_tokenizer(tokenizer)
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_table(docs.select("text"), file, sample_rows))  # TABLE_ENTRIES at most
    content = spark.sparkContext.broadcast(file)
    place = place_of(without(docs, out), "text")

    def counted():
        counter, known = TokenCounter.of(content.value), frequent.value
        return lambda b: pa.array([counter.count(t, known) if t else 0 for t in b.column(place).to_pylist()], pa.int64())

    return appended(docs, out, counted, F.lit(0).cast("long"))


def op7_token_counts(spark, sf_dir: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more tokens than ``limit``; see count_tokens() for odd rows."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    counted = count_tokens(docs)
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
