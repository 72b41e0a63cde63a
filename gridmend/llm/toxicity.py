"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

The lexicon holds words that labelled documents show to be toxic. Every different word of a text is looked up once
for each worker: the automaton of strings within one edit of the word (two for long words) is run down the trie, as
bit masks of how much of the word is read with how many edits. Words that clean documents use are never taken for a
misspelling. A hit counts as quoted if quotation marks enclose it or a word of reporting stands within its window.
A logistic regression over direct, misspelled and quoted hits gives the score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, claim, erase, place_of, portions, small_batches, table, without, written
from .learning import fit_logistic, labelled_sample, remainder, sigmoid

#: The bound of the fit: labelled rows. What is learned from them is kept whole: the lexicon and the clean words that
#: resemble it are part of their vocabulary.
FIT_ROWS = 20_000
#: A lexicon word occurs in so many toxic documents and contexts at least, with such log-odds, and so seldom by chance (the
#: likelihood-ratio statistic; 25 is met by one in two million words that tell nothing).
SUPPORT, LOG_ODDS, EVIDENCE = 4, 2.0, 25.0
#: Words on each side of a hit that are its context, and words whose classes a worker keeps.
WINDOW, CACHE = 6, 300_000
WORD = re.compile(r"\w+")
QUOTES = re.compile("[\"“”„«»]")
#: Words of reporting in four languages.
REPORTING = frozenset("said says say quote quoted quotes quoting wrote writes called reported term word phrase dit disait cite citation mot sagte sagt zitat zitiert wort dijo dice cita citado palabra".split())


def edits_for(word: str) -> int:
    """Edits that a lexicon word allows: none under five letters, where one makes most words into another."""
    return 0 if len(word) < 5 else 1 if len(word) < 12 else 2


def build_trie(words: Iterable[str]) -> dict:
    """Nested dicts by letter; the key "" marks the end of a word and holds it."""
    root: dict = {}
    for w in words:
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = w
    return root


def within(trie: dict, word: str, edits: int) -> list[tuple[int, str]]:
    """(edits, lexicon word) of all words of the trie within ``edits`` of ``word``.

    Bit i of mask k: the first i letters of ``word`` are read with at most k edits.
    """
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << i
    full, end = (1 << len(word) + 1) - 1, 1 << len(word)
    start = [(1 << k + 1) - 1 for k in range(edits + 1)]
    found, stack = [], [(trie, start)]
    while stack:
        node, now = stack.pop()
        for c, below in node.items():
            if c == "":
                k = next((k for k, mask in enumerate(now) if mask & end), None)
                if k is not None:
                    found.append((k, below))
                continue
            same = at.get(c, 0)
            last = (now[0] & same) << 1
            new = [last]
            for k in range(1, edits + 1):
                last = ((now[k] & same) << 1 | now[k - 1] | now[k - 1] << 1 | last << 1) & full
                new.append(last)
            if last:
                stack.append((below, new))
    return found


class Pieces:
    """Which strings can be within some edits of a word at all.

    A word in k + 1 pieces keeps one of them whole under k edits: the first one begins the string, the last one ends
    it, and one between lies somewhere in it. Few strings have such a piece, and only these are given to the automaton.
    """

    def __init__(self, words: Iterable[str], edits: int) -> None:
        first, between, last = set(), set(), set()
        for w in words:
            n = len(w) // (edits + 1)
            first.add(w[:n])
            last.add(w[n * edits :])
            between.update(w[n * i : n * (i + 1)] for i in range(1, edits))
        self.first, self.between, self.last = (sorted({len(x) for x in part}) for part in (first, between, last))
        self.firsts, self.betweens, self.lasts = first, between, last

    def may(self, word: str) -> bool:
        for n in self.first:
            if word[:n] in self.firsts:
                return True
        for n in self.last:
            if word[max(0, len(word) - n) :] in self.lasts:
                return True
        return any(word[i : i + n] in self.betweens for n in self.between for i in range(len(word) - n + 1))


@dataclass
class Lexicon:
    """``odds``: log-odds of lexicon words; ``clean``: words that aren't misspellings; ``weights``: of the score."""

    odds: dict[str, float]
    clean: frozenset[str]
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        #: For each number of edits, the words that allow so many.
        allow = {k: [w for w in self.odds if edits_for(w) == k] for k in (1, 2)}
        self.tries = {k: build_trie(words) for k, words in allow.items()}
        self.pieces = {k: Pieces(words, k) for k, words in allow.items()}
        self.lengths = {k: (min(map(len, words), default=0) - k, max(map(len, words), default=-9) + k) for k, words in allow.items()}
        self.cache: dict[str, tuple[float, int] | None] = {}

    def __getstate__(self) -> dict:
        return {"odds": self.odds, "clean": self.clean, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def look_up(self, word: str) -> tuple[float, int] | None:
        """(log-odds, edits) of the closest lexicon word, the likeliest of these, or None."""
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        found = None
        if word in self.odds:
            found = (self.odds[word], 0)
        elif word not in self.clean:
            near = [x for k, (least, most) in self.lengths.items() if least <= len(word) <= most and self.pieces[k].may(word) for x in within(self.tries[k], word, k)]
            if near:
                edits, odds = min((k, -self.odds[w]) for k, w in near)
                found = (-odds, edits)
        self.cache[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Sums over hits, by direct, misspelled and quoted; the highest direct odds; direct hits over the root of
        the words, since a long text has some by chance."""
        text = text.lower()
        words = WORD.findall(text)
        hits = {w: h for w in set(words) if (h := self.look_up(w))}
        direct = misspelled = quoted = top = 0.0
        if hits:
            spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
            marks = [m.start() for m in QUOTES.finditer(text)]
            for i, (w, start, end) in enumerate(spans):
                if w not in hits:
                    continue
                odds, edits = hits[w]
                before = spans[i - WINDOW - 1][2] if i > WINDOW else 0
                after = spans[i + WINDOW + 1][1] if i + WINDOW + 1 < len(spans) else len(text)
                enclosed = bisect_left(marks, before) < bisect_left(marks, start) and bisect_left(marks, end) < bisect_left(marks, after)
                reported = any(spans[j][0] in REPORTING for j in range(max(0, i - WINDOW), min(len(spans), i + WINDOW + 1)))
                if enclosed or reported:
                    quoted += odds
                elif edits:
                    misspelled += odds
                else:
                    direct += odds
                    top = max(top, odds)
        return [np.log1p(direct), np.log1p(misspelled), np.log1p(quoted), top, direct / max(len(words), 1) ** 0.5]

    def score(self, texts: list[str | None]) -> np.ndarray:
        claim(__name__, self.cache.clear)
        x = np.array([self.features(t or "") for t in texts]).reshape(len(texts), -1)
        return sigmoid(np.column_stack([x, np.ones(len(x))]) @ self.weights)


#: Counts of documents by label and fold.
FOLDS = (0, 1, 2)
KINDS = [(y, fold) for y in (1, 0) for fold in FOLDS]
NAMES = [f"{('good', 'bad')[y]}{fold}" for y, fold in KINDS]
#: What the weights shrink to where the labelled rows don't tell: quoted words weigh a third of direct ones.
PRIOR = np.array([1.0, 0.6, 0.3, 0.3, 1.0])


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = FIT_ROWS, label: str = "toxic") -> Lexicon:
    """The lexicon and the weights, from at most ``rows`` labelled documents. Without toxic ones nothing is found.
    Null texts and null labels teach nothing; repeated texts count once.

    A lexicon flatters the documents that it is made from. So each third of them is looked at with a lexicon of the
    other two when the weights are fitted; the final lexicon is of all.
    """
    sample = labelled_sample(docs, labels, label, rows, train).groupBy("text").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    sample = written(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int")), "toxic-sample")
    sizes = {(r.y, r.fold): r["count"] for r in sample.groupBy("y", "fold").count().collect()}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {kind: Counter() for kind in KINDS}
        for b in portions(batches):
            for t, y, fold in zip(*(b.column(k).to_pylist() for k in ("text", "y", "fold")), strict=True):
                seen[int(y == 1), fold].update(set(WORD.findall(t.lower())))
        words = list(set().union(*seen.values()))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[kind][w] for w in words], pa.int64()) for kind in KINDS)], names=["word", *NAMES])

    counts = sample.mapInArrow(tally, "word string, " + ", ".join(f"{n} long" for n in NAMES)).groupBy("word").agg(*(F.sum(n).alias(n) for n in NAMES))
    counts = written(counts.where(" + ".join(NAMES) + " > 1"), "word-counts")

    every = [tuple(f for f in FOLDS if f != fold) for fold in FOLDS] + [FOLDS]

    def toxic_words(folds: tuple[int, ...]) -> dict[str, float]:
        """Words by log-odds; all that pass, out of the vocabulary of the sample."""
        bad, good, n_bad, n_good = seen(folds)
        odds = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
        share = n_bad / max(n_bad + n_good, 1)
        part = lambda k, p: F.when((k > 0) & (p > 0), k * F.log(k / ((bad + good) * p))).otherwise(0.0)
        evidence = 2 * (part(bad, F.lit(share)) + part(good, F.lit(1 - share)))
        best = counts.where((bad >= SUPPORT) & (odds >= LOG_ODDS) & (evidence >= EVIDENCE))
        return {r.word: r.odds for r in best.select("word", odds.alias("odds")).collect()}

    def seen(folds: tuple[int, ...]) -> tuple:
        bad, good = (sum((F.col(f"{k}{f}") for f in folds), F.lit(0)) for k in ("bad", "good"))
        return bad, good, *(sum(sizes.get((y, f), 0) for f in folds) for y in (1, 0))

    found = [toxic_words(folds) for folds in every]
    asked = set().union(*found)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for b in portions(batches):
            for t, fold in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall(t.lower())
                met.update((w, words[i - 1] if i else "", fold) for i, w in enumerate(words) if w in asked)
        parts = list(zip(*met, strict=True)) if met else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.string()), pa.array(parts[2], pa.int32()), pa.array(met.values(), pa.int64())], names=["word", "before", "fold", "n"])

    # copies of one toxic text make all of its words look toxic: but these follow the same words again and again
    texts = sample.where(F.col("y") == 1).select("text", "fold")
    pairs = texts.mapInArrow(contexts, "word string, before string, fold int, n long").groupBy("word", "before").pivot("fold", list(FOLDS)).agg(F.sum("n"))
    by_fold = lambda folds: sum((F.coalesce(F.col(str(f)), F.lit(0)) for f in folds), F.lit(0))
    spreads = [(F.pow(F.sum(by_fold(folds)), 2) / F.sum(by_fold(folds) * by_fold(folds))).alias(f"s{i}") for i, folds in enumerate(every)]
    various = {r.word: r for r in pairs.groupBy("word").agg(*spreads).collect()}
    lexicons = [Lexicon({w: odds for w, odds in sorted(words.items()) if w in various and (various[w][f"s{i}"] or 0) >= SUPPORT}, frozenset()) for i, words in enumerate(found)]

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that a lexicon would take for misspelled, with the numbers of these lexicons."""
        for b in portions(batches):
            of = [[i for i, x in enumerate(lexicons) if w not in x.odds and x.look_up(w) is not None] for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of, pa.list_(pa.int32()))], names=[*b.schema.names, "alike"]).filter(pa.array([bool(x) for x in of], pa.bool_()))

    near = counts.mapInArrow(alike, counts.withColumn("alike", F.array().cast("array<int>")).schema)
    clean = [F.array_contains("alike", i) & (seen(folds)[1] >= 2) for i, folds in enumerate(every)]
    rows = near.select("word", *(c.alias(f"c{i}") for i, c in enumerate(clean))).collect()
    lexicons = [Lexicon(x.odds, frozenset(r.word for r in rows if r[f"c{i}"])) for i, x in enumerate(lexicons)]

    def features(found: Lexicon):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in portions(batches):
                yield pa.RecordBatch.from_arrays([pa.array([found.features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

        return of

    got = []
    for fold in FOLDS:  # FIT_ROWS at most in all, a few numbers each
        got += sample.where(F.col("fold") == fold).select("text", "y").mapInArrow(features(lexicons[fold]), "x array<double>, y int").collect()
    x, y = np.array([r.x for r in got]).reshape(len(got), len(PRIOR)), np.array([r.y for r in got], float)
    final = lexicons[-1]
    final.weights = fit_logistic(x, y, 1.0, PRIOR) if y.any() else np.append(PRIOR, -4.0)
    erase(sample, counts)
    return final


def score_toxicity(docs: DataFrame, lexicon: Lexicon, out: str = "score") -> DataFrame:
    """``docs`` (text and any others) with a score from 0 to 1; null and empty texts have that of a text without hits.
    A column named ``out`` is replaced."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon)  # words of FIT_ROWS labelled texts
    place = place_of(without(docs, out), "text")
    return appended(docs, out, lambda: lambda b: pa.array(known.value.score(b.column(place).to_pylist()), pa.float64()), F.lit(0.0))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labelled rows that aren't held out. Null texts count as empty, very long ones
    are read whole; repeated rows get the same score; an empty table gives an empty result."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    lexicon = fit(docs, labels, remainder(5) != 0)
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
