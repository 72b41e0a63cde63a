"""Quality by compression: dictionaries of good and of bad labelled text, and a calibrated score.

A text is compressed with a zstandard dictionary built from good texts, with one built from bad texts, and with none.
With a dictionary it is taken in pieces, all of them, since a long text soon becomes its own dictionary. The difference
of the two sums of sizes, normalised, tells which kind the text resembles; how far it shrinks at all corrects for
repetition and length. A logistic regression on labelled rows that the dictionaries haven't seen makes
a probability of these.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, place_of, quoted, small_batches, table, without
from .learning import fit_logistic, labelled_sample, remainder, sigmoid

#: Bounds of the fit: labelled rows, bytes of a text that is used for it. At most 160 MB reach the driver, about
#: 20 MB with texts of usual length.
FIT_ROWS, FIT_BYTES = 8_000, 20_000
DICTIONARY_BYTES, LEVEL, PIECE = 112_640, 3, 1024


def dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary. Where the texts are too few to train one, they are the dictionary themselves: whole ones,
    in order, as many as its size holds."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts)
    except zstandard.ZstdError:
        some, room = [], DICTIONARY_BYTES
        for t in texts:
            if t and len(t) < room:
                some.append(t)
                room -= len(t) + 1
        return zstandard.ZstdCompressionDict(b"\n".join(some).ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Compressors:
    """The three compressors, made anew in each worker; ``weights`` follow standardised features."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self.parts = (bad, good)
        self.mean = self.spread = self.weights = None
        self._make()

    def _make(self) -> None:
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.bad, self.good = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(p), **plain) for p in self.parts)
        self.none = zstandard.ZstdCompressor(**plain)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("bad", "good", "none")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._make()

    def features(self, text: bytes) -> list[float]:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]
        bad, good = (sum(len(c.compress(p)) for p in pieces) for c in (self.bad, self.good))
        shrinks, size = np.log((len(text) + 1) / (len(self.none.compress(text)) + 1)), np.log(len(text) + 1) / 10
        return [(bad - good) / max(bad, good), np.log((bad + 20) / (good + 20)), 3 * (bad - good) / (len(text) + 50), shrinks, shrinks * shrinks, size, size * size, shrinks * size]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), 0.5)
        x = (np.array([self.features((t or "").encode("utf-8", "surrogatepass")) for t in texts]) - self.mean) / self.spread
        return sigmoid(np.column_stack([x, np.ones(len(x))]) @ self.weights)


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = FIT_ROWS, label: str = "quality") -> Compressors:
    """Dictionaries from half of the labelled sample, calibration on the other half.

    Only texts of FIT_BYTES at most are in the sample, whole. Without labelled rows of both kinds every score is
    0.5.
    """
    sample = labelled_sample(docs.where(F.octet_length("text") <= FIT_BYTES), labels, label, rows, train)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    got = sample.select("doc_id", "text", "y", half).orderBy("doc_id").collect()  # FIT_ROWS at most
    encoded = [(r.text.encode("utf-8", "surrogatepass"), r.y, r.half) for r in got]
    made = Compressors(*(dictionary([t for t, y, h in encoded if y == k and h == 0]).as_bytes() for k in (0, 1)))
    rest = [(made.features(t), y) for t, y, h in encoded if h == 1]
    x, y = np.array([f for f, _ in rest]), np.array([k for _, k in rest], float)
    if 0 < y.sum() < len(y):
        made.mean, made.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        made.weights = fit_logistic((x - made.mean) / made.spread, y)
    return made


def score_quality(docs: DataFrame, model: Compressors, out: str = "score") -> DataFrame:
    """``docs`` (text and any others) with the probability of good quality; null texts are scored as empty ones.
    A column named ``out`` is replaced."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    place = place_of(without(docs, out), "text")
    return appended(docs, out, lambda: lambda b: pa.array(known.value.score(b.column(place).to_pylist()), pa.float64()), F.lit(0.0))


def classify_filter(docs: DataFrame, labels: DataFrame, train, least: float = 0.5, model_docs: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, columns unchanged. ``model_docs``: what is learned from,
    ``docs`` themselves by default.

    Null texts are scored as empty ones, very long ones whole; repeated rows are judged alike; an empty table gives
    an empty table. Columns of any other name are carried along, whatever they are called.
    """
    model = fit(docs if model_docs is None else model_docs, labels, train)
    packed = docs.select(F.struct(*quoted(docs.columns)).alias("gm_row"))
    known, place = docs.sparkSession.sparkContext.broadcast(model), place_of(docs.columns, "text")
    # the text is looked up in its row: a column of its own beside it would send each text to Python and back twice
    score = lambda: lambda b: pa.array(known.value.score(b.column(0).field(place).to_pylist()), pa.float64())
    return appended(packed, "gm_score", score, F.lit(0.0)).where(F.col("gm_score") >= least).select("gm_row.*")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labelled rows that aren't held out. Null texts count as empty, very
    long ones are compressed whole, in pieces; repeated rows get the same score; an empty table gives an empty result."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), remainder(3) != 1)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
