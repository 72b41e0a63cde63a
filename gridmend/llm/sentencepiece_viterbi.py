"""SentencePiece encoding and decoding as a streaming Viterbi search.

For each position of a text exactly one piece can be the last one of an encoding that ends there: a piece is a
candidate if the encoding up to its start ends with a piece that it is compatible with, that is, if merging the two
pieces' letters from scratch gives these two pieces again. So every position has one surviving backpointer, and the
encoder needs a window of the last positions only: it follows the backpointers of all positions where a later piece
could still begin, and commits the ids before the boundary on which they all meet. That is so at the end of each word,
over which no piece goes, and within a longer run of letters whenever the window is full. A word that begins at a commit
always has the same ids, so a worker remembers them.

The model's rule is byte-pair merging with byte fallback, for which highest summed scores would give other ids than
the library's; compatibility replaces the sum, and the ids are the library's.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, claim, place_of, portions, small_batches, table, without

#: The letter that stands for a space, a fixed value of the format.
SPACE = "▁"
#: Stretches that no piece goes beyond: none has a space after another letter, and a line break is no piece.
SEGMENTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Segments of a generation of a worker's cache, letters of the longest one kept, and pairs whose compatibility it keeps.
CACHE, KEPT_LETTERS, PAIRS = 400_000, 64, 500_000
#: Lengths of pieces that are tried at every position.
SHORT = (3, 2, 1)


def closes(before: str, after: str) -> bool:
    """Whether no piece goes over the place between two letters."""
    return before == "\n" or after == "\n" or (after == SPACE and before != SPACE)


def fields(message: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message by number: whole numbers, or bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value, at

    out: dict[int, list] = {}
    at = 0
    while at < len(message):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else number(at)
            value, at = message[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def refused(proto: bytes) -> str | None:
    """Why a model file can't be served, or None. The numbers are those of the format's fields, fixed values."""
    model = fields(proto)
    trainer, normalizer = (fields(model[k][0]) if k in model else {} for k in (2, 3))
    last = lambda part, k, default: part.get(k, [default])[-1]
    if last(trainer, 3, 1) != 2:
        return "it doesn't merge byte pairs"
    if not last(trainer, 35, 0):
        return "it has no pieces for single bytes"
    if last(trainer, 24, 0):
        return "it puts spaces after words"
    if last(normalizer, 2, b"") or not last(normalizer, 3, 1) or last(normalizer, 4, 1) or not last(normalizer, 5, 1):
        return "it normalises texts in another way than by a space put before them"
    if any(last(fields(p), 3, 1) == 4 for p in model.get(1, [])):
        return "it has pieces defined by its user"
    return None


@dataclass(frozen=True)
class Model:
    """The vocabulary: ``pieces`` by id, their ``scores``, and the ids of the 256 bytes."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]

    @staticmethod
    def read(path: str | None = None) -> Model:
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if why := refused(sp.serialized_model_proto()):
            raise ValueError(f"this model isn't supported: {why}")
        ids = range(sp.get_piece_size())
        pieces = tuple(sp.id_to_piece(i) for i in ids)
        at = {p: i for i, p in enumerate(pieces)}
        normal = tuple(not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids)
        if any(n and (SPACE in p.lstrip(SPACE) or "\n" in p) for n, p in zip(normal, pieces, strict=True)):
            raise ValueError("pieces that span words or lines aren't supported")
        return Model(pieces, tuple(sp.get_score(i) for i in ids), normal, tuple(at[f"<0x{b:02X}>"] for b in range(256)))


class Codec:
    """Encodes and decodes; one for each model in a worker."""

    made: dict[str, Codec] = {}

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids = {p: i for i, (p, n) in enumerate(zip(model.pieces, model.normal, strict=True)) if n}
        self.longest = max(map(len, self.ids), default=1)
        self.pairs: dict[int, bool] = {}
        #: Two generations: what is asked for moves to the young one, and the old one is dropped when that is full.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # pieces whose own letters merge into something else are never used
        self.ids = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        #: For each last four letters, the lengths of the pieces that end with them, longest first; then SHORT.
        found: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 3:
                found.setdefault(p[-4:], set()).add(len(p))
        self.lengths = {k: (*sorted(v, reverse=True), *SHORT) for k, v in found.items()}
        bytes_of = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
        self.said = [bytes_of.get(i, p.replace(SPACE, " ").encode() if n else b"") for i, (p, n) in enumerate(zip(model.pieces, model.normal, strict=True))]

    @classmethod
    def of(cls, model: Model) -> Codec:
        claim(__name__, cls.made.clear)
        key = hashlib.sha256("\n".join(model.pieces).encode()).hexdigest()
        if key not in cls.made:
            cls.made[key] = cls(model)
        return cls.made[key]

    def merged(self, text: str) -> list[str]:
        """Pieces by definition: the best adjacent pair is merged, the leftmost of equals, until none is a piece."""
        parts, scores, ids = list(text), self.model.scores, self.ids
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether the letters of pieces a and b merge into a and b."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        x, y = self.model.pieces[a], self.model.pieces[b]
        found = self.pairs[a << 32 | b] = self.merged(x + y) == [x, y]
        return found

    def advance(self, text: str, begins: list[int], last: list[int]) -> None:
        """Carries the search on to the end of ``text``. For each position: where its last piece begins, and that
        piece (-1: bytes, or none)."""
        piece_of, known, lengths = self.ids.get, self.pairs.get, self.lengths.get
        for i in range(len(begins), len(text) + 1):
            for n in lengths(text[i - 4 : i], SHORT) if i > 3 else SHORT:
                j = i - n
                if j >= 0:
                    p = piece_of(text[j:i])
                    if p is not None:
                        before = last[j]
                        if before < 0:
                            break
                        fit = known(before << 32 | p)
                        if fit is None:
                            fit = self.fits(before, p)
                        if fit:
                            break
            else:
                j, p = i - 1, -1
            begins.append(j)
            last.append(p)

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Ids (int32) of a normalised text that comes in chunks, in portions, each as soon as no later letter can
        change it. What is open is never longer than the window of 4 x the longest piece."""
        text, begins, last, window = "", [0], [-1], 4 * self.longest
        out: list[bytes] = []
        for chunk in chunks:
            if text and chunk and closes(text[-1], chunk[0]):
                out.append(self.commit(text, begins, last, (len(text),))[0])
                text, begins, last = "", [0], [-1]
            segments = SEGMENTS.findall(chunk)
            open_ = segments.pop() if segments else ""
            if text and segments:  # the first stretch closes what is open
                text, begins, last = self.search(segments[0], text, begins, last, window, out)
                out.append(self.commit(text, begins, last, (len(text),))[0])
                text, begins, last, segments = "", [0], [-1], segments[1:]
            get, add = self.young.get, out.append
            for s in segments:
                ids = get(s)
                if ids is None:
                    ids = self.whole(s, window)
                    get = self.young.get
                add(ids)
            text, begins, last = self.search(open_, text, begins, last, window, out)
            if out:
                yield b"".join(out)
                out.clear()
        if text:
            yield self.commit(text, begins, last, (len(text),))[0]

    def whole(self, segment: str, window: int) -> bytes:
        """The ids of a stretch that begins and ends at a commit."""
        ids = self.old.get(segment)
        if ids is None:
            out: list[bytes] = []
            text, begins, last = self.search(segment, "", [0], [-1], window, out)
            out.append(self.commit(text, begins, last, (len(text),))[0])
            ids = b"".join(out)
        self.keep(segment, ids)
        return ids

    def search(self, letters: str, text: str, begins: list[int], last: list[int], window: int, out: list[bytes]) -> tuple[str, list[int], list[int]]:
        """What is open after further letters that nothing closes; what is sure before that goes to ``out``."""
        for at in range(0, len(letters), window):
            text += letters[at : at + window]
            self.advance(text, begins, last)
            if len(text) >= window:
                ids, cut = self.commit(text, begins, last, range(max(0, len(begins) - self.longest), len(begins)))
                if cut:
                    out.append(ids)
                    # the piece that ends at the cut stays known: it decides what may follow
                    text, begins, last = text[cut:], [0, *(j - cut for j in begins[cut + 1 :])], last[cut:]
        return text, begins, last

    def keep(self, segment: str, ids: bytes) -> None:
        if len(segment) <= KEPT_LETTERS:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[segment] = ids

    def commit(self, text: str, begins: list[int], last: list[int], open_: Iterable[int]) -> tuple[bytes, int]:
        """The ids before the boundary on which the paths of all positions meet where a piece may yet begin, and it."""
        cut = self.meeting(begins, open_)
        return array("i", self.path(text, begins, last, cut)).tobytes(), cut

    @staticmethod
    def meeting(begins: list[int], open_: Iterable[int]) -> int:
        """The last boundary that the paths of all these positions have in common."""
        alive = set(open_)
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(begins[last])
        return alive.pop()

    def path(self, text: str, begins: list[int], last: list[int], end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            start = begins[end]
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(self.model.byte_ids[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass")))
            end = start
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as int32."""
        if not text:
            return np.empty(0, np.int32)
        return np.frombuffer(b"".join(self.stream((SPACE + text.replace(" ", SPACE),))), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, and the space put before the text goes."""
        text = b"".join(map(self.said.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_column(docs: DataFrame, model: Model, out: str = "ids") -> DataFrame:
    """``docs`` (text and any others) with the ids of each whole text; null and empty texts have none.
    A column named ``out`` is replaced."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary of fixed size
    place = place_of(without(docs, out), "text")

    def encoded():
        codec = Codec.of(known.value)

        def of(b: pa.RecordBatch) -> pa.Array:
            ids = [codec.encode(t or "") for t in b.column(place).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

        return of

    return appended(docs, out, encoded, F.array().cast("array<int>"))


def decode_column(rows: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in a column; null ids have an empty text, ids outside the vocabulary fail.
    A column named ``out`` is replaced."""
    known = rows.sparkSession.sparkContext.broadcast(model)
    place = place_of(without(rows, out), ids)

    def decoded():
        codec = Codec.of(known.value)
        return lambda b: pa.array([codec.decode(x or ()) for x in b.column(place).to_pylist()], pa.string())

    return appended(rows, out, decoded, F.lit(""))


def encoded_and_decoded(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_ids, ids, decoded_sha256, exact) of ``docs`` (doc_id, text): the ids, a digest of the text that they
    decode to, and whether it is the text itself. One pass, and one worker for a task, does both.

    Null texts are empty, and empty texts have no ids. Very long texts are read whole, with a window of constant size.
    Repeated rows stay apart. An empty table gives an empty result; columns of other names are left out. A text that
    holds the letter that stands for a space isn't exact: it decodes to a space."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(known.value)
        for b in portions(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [codec.encode(t) for t in texts]
            decoded = [codec.decode(x.tolist()) for x in ids]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            digests = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded], pa.string())
            exact = pa.array([a == t for a, t in zip(decoded, texts, strict=True)], pa.bool_())
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), n, column, digests, exact], names=["doc_id", "n_ids", "ids", "decoded_sha256", "exact"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n_ids long, ids array<int>, decoded_sha256 string, exact boolean")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The ids of every document, and how they decode; see encoded_and_decoded() for odd rows."""
    small_batches(spark)
    return encoded_and_decoded(table(spark, sf_dir, "documents", "doc_id", "text"), Model.read())
