"""Mixing to target weights with soft membership.

A classifier is learned from the documents that the label table covers and gives each document a posterior over
domains. Document rates r >= 0 are then fitted so that the expected tokens of each domain, the sum of
rate x tokens x posterior, have the target shares of the corpus: least squares by projected gradient steps with
momentum, measured in the metric that the domains' second moments give, so that a rare domain takes no more steps than
a frequent one. A step needs the domains' totals only. As every rate starts at 1 and moves by the product of its posterior
with vectors that are the same for all, a rate is replayed from those vectors; from time to time a narrow table of the
rates so far is written, so that a step replays CARRY steps at most.

Domains are the languages of the documents that the label table covers. What other documents have in that column is
never looked at. A token is a word, or a single letter of a script that is written without spaces; other counts, those
of a tokenizer for instance, can be given as a column.

Targets that no rates meet are reported with what is left. The number of domains isn't limited; the classifier that is
broadcast has 0.26 MB for each.
"""

from __future__ import annotations

import hashlib
import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, erase, portions, quoted, small_batches, table, written

#: Documents that the fit takes; hashed words of the classifier; steps after which rates are written; the error of a share at
#: which steps end, and how many steps may pass without an error that is less by a hundredth until targets count as out of reach.
FIT_ROWS, BUCKETS, CARRY, ENOUGH, PATIENCE = 20_000, 1 << 15, 10, 2e-4, 200
#: Letters of scripts without spaces: Thai to Burmese, Khmer, kana, Han.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{ALONE}]|[^\\W{ALONE}]+")


@dataclass
class Classifier:
    """Naive Bayes over hashed words. ``temper``: the power of a text's length that its evidence is divided by."""

    domains: list[str]
    prior: np.ndarray
    evidence: np.ndarray
    temper: float = 0.5
    cache: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}}

    def buckets(self, text: str) -> np.ndarray:
        cache, out = self.cache, []
        for w in WORD.findall(text.lower()):
            b = cache.get(w)
            if b is None:
                if len(cache) >= 200_000:
                    cache.clear()
                b = cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
            out.append(b)
        return np.array(out, np.int64)

    def sums(self, text: str) -> tuple[int, np.ndarray]:
        at = self.buckets(text)
        return len(at), self.evidence[:, at].sum(axis=1)

    def read(self, text: str) -> tuple[int, np.ndarray]:
        """Tokens and posterior."""
        n, total = self.sums(text)
        z = self.prior + total / max(n, 1) ** self.temper
        p = np.exp(z - z.max())
        return n, p / p.sum()


def labelled_domains(docs: DataFrame, labels: DataFrame, domain: str, rows: int) -> tuple[dict[str, int], DataFrame]:
    """How many labelled documents each domain has, and a sample (text, domain, fifth) of about ``rows`` of them.

    Half of the sample is dealt by size and half evenly, so that rare domains are in it too. Ids are taken by their
    hashes. Of repeated documents with one id the least text is taken.
    """
    known = docs.where(F.col(domain).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(domain).cast("string").alias("domain"))
    known = written(known.join(labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id"), "mixing-labelled")
    sizes = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}  # one row for each domain
    if not sizes:
        return {"all": 0}, written(docs.where("false").select("text", F.lit("").alias("domain"), F.lit(False).alias("fifth")), "mixing-sample")
    total = sum(sizes.values())
    part = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, rows / 2 / total + rows / 2 / len(sizes) / n))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    picked = known.where(chance < F.element_at(part, F.col("domain"))).select("doc_id").distinct()  # the documented bound, about
    met = docs.select("doc_id", "text", F.col(domain).cast("string").alias("domain")).where("text is not null and domain is not null").join(F.broadcast(picked), "doc_id")
    sample = met.groupBy("doc_id").agg(F.min(F.struct("text", "domain")).alias("x"))
    sample = written(sample.select("x.*", (F.pmod(F.xxhash64("doc_id", F.lit("fifth")), F.lit(5)) == 0).alias("fifth")), "mixing-sample")
    erase(known)
    return sizes, sample


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str = "lang", rows: int = FIT_ROWS) -> Classifier:
    """From about ``rows`` documents that the label table covers and that have a domain; priors are from all of these.
    The temper is the one with the least log loss on a fifth of the sample."""
    sizes, sample = labelled_domains(docs, labels, domain, rows)
    names = sorted(sizes)
    place, blank = {d: i for i, d in enumerate(names)}, Classifier([], np.empty(0), np.empty((0, 0)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(names), BUCKETS), np.int64)
        for b in portions(batches):
            for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d in place:
                    np.add.at(seen[place[d]], blank.buckets(t), 1)
        r, c = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (r, c, seen[r, c])], names=["d", "b", "n"])

    counted = sample.where("not fifth").select("text", "domain").mapInArrow(tally, "d long, b long, n long").groupBy("d", "b").agg(F.sum("n").alias("n")).toArrow()  # domains x BUCKETS at most
    counts, docs_of = np.full((len(names), BUCKETS), 0.1), np.array([sizes[d] + 1.0 for d in names])
    counts[counted["d"].to_numpy(), counted["b"].to_numpy()] += counted["n"].to_numpy()
    made = Classifier(names, np.log(docs_of / docs_of.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)))

    powers = (0.0, 0.25, 0.5, 0.75, 1.0)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(powers))
        for b in portions(batches):
            for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d in place:
                    n, sums = made.sums(t)
                    for k, power in enumerate(powers):
                        z = made.prior + sums / max(n, 1) ** power
                        total[k] += np.log(np.exp(z - z.max()).sum()) - (z[place[d]] - z.max())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(powers)), pa.int64()), pa.array(total, pa.float64())], names=["k", "loss"])

    found = sample.where("fifth").select("text", "domain").mapInArrow(losses, "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    if found and any(r.loss > 0 for r in found):
        made.temper = powers[min(found, key=lambda r: (r.loss, r.k)).k]
    erase(sample)
    return made


def momentum(first: int, steps: int) -> Iterator[float]:
    """The factors of so many steps from the ``first`` one on."""
    t = 1.0
    for k in range(first + steps):
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if k >= first:
            yield (t - 1) / after
        t = after


def replay(p: np.ndarray, pushes: list[np.ndarray], done: int = 0, rate: np.ndarray | None = None, point: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rates of documents with posteriors ``p`` after more steps, and the point of the next gradient; ``rate`` and
    ``point`` are those after the ``done`` steps before."""
    if rate is None:
        rate = point = np.ones(len(p))
    for beta, push in zip(momentum(done, len(pushes)), pushes, strict=True):
        new = np.maximum(0.0, point - p @ push)
        point = new + beta * (new - rate)
        rate = new
    return rate, point


@dataclass
class Mix:
    classifier: Classifier
    targets: np.ndarray
    pushes: list[np.ndarray]
    shares: np.ndarray

    @property
    def residual(self) -> float:
        """The largest error of a share of the expected tokens."""
        return float(np.abs(self.shares - self.targets).max())

    def rates(self, p: np.ndarray) -> np.ndarray:
        return replay(p, self.pushes)[0]


def members(docs: DataFrame, classifier: Classifier, kept: list[str] | None = None, tokens: str | None = None) -> DataFrame:
    """(gm_row, n, p, u) for each row of ``docs`` (doc_id, text): its ``kept`` columns (doc_id by default), tokens,
    posterior and draw. ``tokens``: a column of token counts; else the tokens that the classifier reads are counted."""
    known = docs.sparkSession.sparkContext.broadcast(classifier)  # domains x BUCKETS numbers
    kept = kept or ["doc_id"]
    packed = docs.select("doc_id", "text", F.col(tokens).cast("long").alias("n") if tokens else F.lit(None).cast("long").alias("n"), F.struct(*quoted(kept)).alias("gm_row"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, known.value.cache.clear)
        for b in portions(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [known.value.read(t) for t in texts]
            p = pa.array([x for _, x in found], pa.list_(pa.float64()))
            n = [max(0, given) if given is not None else n for given, (n, _) in zip(b.column(2).to_pylist(), found, strict=True)]
            u = pa.array([draw(i, t) for i, t in zip(b.column(0).to_pylist(), texts, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(n, pa.int64()), p, u], names=["gm_row", "n", "p", "u"])

    return packed.mapInArrow(of, packed.select("gm_row", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.array(F.lit(0.0)).alias("p"), F.lit(0.0).alias("u")).schema)


def fit_rates(table_: DataFrame, classifier: Classifier, targets: dict[str, float] | None = None) -> Mix:
    """The steps that lead from equal rates to the targets. ``table_`` has columns n and p.

    ``targets``: weights by domain; domains that aren't named get none, and without targets all weigh the same.
    Warns if no rates meet them.
    """
    d = len(classifier.domains)
    unknown = sorted(k for k, w in (targets or {}).items() if w > 0 and k not in classifier.domains)
    if unknown:
        raise ValueError(f"targets name domains that the classifier doesn't know: {unknown}")
    want = np.array([(targets or {}).get(k, 0.0 if targets else 1.0) for k in classifier.domains])
    if want.sum() <= 0:
        raise ValueError("no target names a domain of the labelled documents")
    want = want / want.sum()
    stats = table_.select("n", "p")

    def added(of, size: int) -> np.ndarray:
        out = np.zeros(size)
        for r in stats.mapInArrow(of, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            out[r.k] = r.x
        return out

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * d + 1)
        for b in batches:
            n, p, *_ = columns(b, d)
            total += np.append(((p * n[:, None]).T @ p).ravel(), n.sum())
        yield sums(total)

    def totals(recent: list[np.ndarray], done: int):
        """Domain totals at the next point and at the rates."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * d)
            for b in batches:
                n, p, rate, point = columns(b, d)
                rate, point = replay(p, recent, done, rate, point)
                total += np.concatenate([(n * point) @ p, (n * rate) @ p])
            yield sums(total)

        return of

    def carried(recent: list[np.ndarray], done: int):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, p, rate, point = columns(b, d)
                rate, point = replay(p, recent, done, rate, point)
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(rate), pa.array(point)], names=["n", "p", "rate", "point"])

        return of

    *second, tokens = added(moments, d * d + 1)
    if tokens <= 0:
        return Mix(classifier, want, [], want)
    whole = np.array(second).reshape(d, d) / tokens
    metric = np.linalg.pinv(whole, rcond=1e-12, hermitian=True)  # in it, steps of length 1 always lead down
    pushes: list[np.ndarray] = []
    done, least, least_at = 0, np.inf, 0
    while True:
        both = added(totals(pushes[done:], done), 2 * d) / tokens
        shares = both[d:]
        error = np.abs(shares - want).max()
        if error < 0.99 * least:
            least, least_at = error, len(pushes)
        if error < ENOUGH or len(pushes) - least_at >= PATIENCE:
            break
        pushes.append(metric @ (both[:d] - want))
        if len(pushes) - done == CARRY:
            after = written(stats.mapInArrow(carried(pushes[done:], done), "n long, p array<double>, rate double, point double"), "mixing-rates")
            if done:
                erase(stats)
            stats, done = after, len(pushes)
    mix = Mix(classifier, want, pushes, shares)
    if mix.residual >= ENOUGH:
        warnings.warn(f"the targets aren't met: a domain's share of the tokens is off by {mix.residual:.4g}", stacklevel=2)
    if done:
        erase(stats)
    return mix


def columns(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, ...]:
    """Tokens, posteriors, and rates and points where they are known."""
    n, p = b.column(0).to_numpy().astype(float), b.column(1).flatten().to_numpy().reshape(-1, d)
    rate, point = (b.column(2).to_numpy(), b.column(3).to_numpy()) if b.num_columns > 2 else (None, None)
    return n, p, rate, point


def sums(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.float64())], names=["k", "x"])


def draw(doc_id: object, text: str) -> float:
    """A uniform number that a row's id and text decide."""
    return int.from_bytes(hashlib.blake2b(f"{doc_id}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") / 2.0**64


def dealt(table_: DataFrame, mix: Mix) -> DataFrame:
    """(gm_row, n, domain, rate, copies) of members: the likeliest domain, the fitted rate, and a whole number of
    copies whose expectation is the rate."""
    known = table_.sparkSession.sparkContext.broadcast(mix)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in portions(batches):
            p = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            rate = m.rates(p)
            copies = np.floor(rate + 1 - b.column(3).to_numpy()).astype(np.int64)
            domain = pa.array([m.classifier.domains[k] for k in p.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), domain, pa.array(rate), pa.array(copies)], names=["gm_row", "n", "domain", "rate", "copies"])

    schema = table_.select("gm_row", "n", F.lit("").alias("domain"), F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies")).schema
    return table_.mapInArrow(of, schema)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, tokens: str | None = None) -> DataFrame:
    """(doc_id, domain, n_tokens, rate, copies) for each row of ``docs`` (doc_id, text, lang): the likeliest domain, the
    fitted rate, and a whole number of copies whose expectation is the rate.

    Null texts are empty: they have the prior as posterior and no tokens. Repeated rows are treated alike, very long
    texts are read whole, an empty table gives an empty result. Without labelled documents there is one domain.
    """
    classifier = fit_classifier(docs, labels)
    table_ = written(members(docs, classifier, tokens=tokens), "members")
    return dealt(table_, fit_rates(table_, classifier, targets)).select("gm_row.doc_id", "domain", F.col("n").alias("n_tokens"), "rate", "copies")


def mix_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, tokens: str | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others), each as often as its copies say, columns unchanged.

    Odd rows are treated as in ``mixed``. A text is scored once: its row is written with its posterior.
    """
    classifier = fit_classifier(docs, labels)
    table_ = written(members(docs, classifier, docs.columns, tokens), "members")
    some = dealt(table_, fit_rates(table_, classifier, targets)).where("copies > 0")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return some.select("gm_row", each.alias("gm_copy")).select("gm_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates and copies of every document for equal shares of all languages; see mixed() for odd rows."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return mixed(docs, table(spark, sf_dir, "labels", "doc_id"))
