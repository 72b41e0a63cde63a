"""Quality rules with adaptive thresholds from mergeable quantile sketches, per language and source.

Everything is DataFrame code. Each text is measured in its own row, once (a window of three words is compared by its
64-bit hash); measures are counted into log-linear
histograms (integers below 64 exactly, above that 32 buckets for each doubling, so a quantile is off by 1/32 at
most). Such a sketch merges by adding counts: executors pre-aggregate, a hot source moves a few hundred counters,
and the sketches of a language or of the whole corpus are sums of those of its sources. A document is rejected if
a measure lies beyond the fence that its own (lang, source) gives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, quoted, table, words_of, written

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WORD = r"[^\x20\x09-\x0D]"
#: Bytes of a fence row are under 200, so this bounds the broadcast at 10 MB; above it the join shuffles.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Rules:
    """``spread``: fences lie so many interquartile ranges beyond the quartiles; ``floors``: least range for each
    measure, so that uniform sources don't get fences that are too tight; ``prior``: quartiles of a source are drawn to
    those of its language as by so many rows, and those of a language to the corpus's. So a source of few rows has nearly the
    fences of its language, one of many its own, and no count of rows makes a jump."""

    spread: int = 6
    prior: int = 50
    floors: tuple[tuple[str, int], ...] = (("symbol_rate", 20), ("word_length", 60), ("dup_line_rate", 80), ("repeat_rate", 80))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur at least twice in the text, first occurrences included."""

    def covered(windows: Column) -> Column:
        same = F.filter(
            windows,
            lambda s, j: (F.get(windows, j - 1)["h"] == s["h"]) | F.coalesce(F.get(windows, j + 1)["h"] == s["h"], F.lit(False)),
        )
        places = F.sort_array(F.transform(same, lambda s: s["i"]))
        return let(
            places,
            lambda p: F.aggregate(F.transform(p, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - at, F.lit(3)))), F.lit(0), lambda a, x: a + x),
        )

    def windows(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(made, repeats))

    def repeats(made: Column) -> Column:
        placed = F.transform(made, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(made)) == F.size(made), F.lit(0)).otherwise(let(F.sort_array(placed), covered))

    return let(words, windows).cast("long")


def measure(text: Column) -> Column:
    """A struct of base counts and of the measures, all integers; null texts count as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(w: Column) -> Column:
        return let(
            F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
                repeated_words(w).alias("n_repeat_words"),
            ),
            rates,
        )

    def per_mille(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.floor(a * 1000 / b)).otherwise(0).cast("long")

    def rates(c: Column) -> Column:
        n = c["n_words"]
        failed = (n < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
        return F.struct(
            *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols")),
            c["lines"]["dup"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            per_mille(c["n_symbols"], n).alias("symbol_rate"),
            F.floor(per_mille(c["word_chars"], n) / 10).cast("long").alias("word_length"),
            per_mille(c["lines"]["dup"], c["lines"]["n"]).alias("dup_line_rate"),
            per_mille(c["n_repeat_words"], n).alias("repeat_rate"),
        )

    return let(words_of(text), of)


def bucket(v: Column) -> Column:
    """The histogram bucket of a whole number that isn't negative."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(e * 32 + F.floor(v / F.pow(F.lit(2.0), e))).cast("int")


def bucket_value(b: Column) -> Column:
    """The least value of a bucket."""
    e = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise((b - 32 * e) * F.pow(F.lit(2.0), e)).cast("long")


def sketches(measured: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, measure, bucket, rows) over the documents that pass the base rules."""
    stack = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(F.col(f"m.{k}")).alias("bucket")) for k, _ in rules.floors)))
    return (
        measured.where(~F.col("m.base_failed"))
        .select("lang", "source", stack.alias("x"))
        .groupBy("lang", "source", "x.measure", "x.bucket")
        .agg(F.count("*").alias("rows"))
    )


def fences(sketch: DataFrame, rules: Rules) -> DataFrame:
    """For each (lang, source) the fences of all measures, from the sketches of source, language and corpus."""

    def quartiles(level: list[str], tag: str) -> DataFrame:
        keys = [*level, "measure"]
        merged = sketch.groupBy(*keys, "bucket").agg(F.sum("rows").alias("rows"))
        upto = W.partitionBy(*keys).orderBy("bucket")
        run = merged.withColumn("upto", F.sum("rows").over(upto)).withColumn("all", F.sum("rows").over(W.partitionBy(*keys)))
        first = lambda quarter: F.min(F.when(F.col("upto") * 4 >= F.col("all") * quarter, F.col("bucket")))
        return run.groupBy(*keys).agg(F.max("all").alias(f"n{tag}"), bucket_value(first(1)).alias(f"lo{tag}"), bucket_value(first(3)).alias(f"hi{tag}"))

    by_source, by_lang, by_all = quartiles(["lang", "source"], "2"), quartiles(["lang"], "1"), quartiles([], "0")
    both = by_source.alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.measure") == F.col("l.measure")))
    both = both.select("s.*", "l.n1", "l.lo1", "l.hi1").join(F.broadcast(by_all), "measure")  # by_all has a row for each measure
    drawn = lambda n, own, to: (n * own + rules.prior * to) / (n + rules.prior)
    pick = lambda k: drawn(F.col("n2"), F.col(f"{k}2"), drawn(F.col("n1"), F.col(f"{k}1"), F.col(f"{k}0")))
    floor = F.element_at(F.create_map(*(F.lit(x) for pair in rules.floors for x in pair)), F.col("measure"))
    picked = both.select("lang", "source", "measure", pick("lo").alias("lo"), pick("hi").alias("hi"), floor.alias("floor"))
    reach = rules.spread * F.greatest(F.col("hi") - F.col("lo"), F.col("floor"))
    spans = picked.select("lang", "source", "measure", (F.col("lo") - reach).alias("least"), (F.col("hi") + reach).alias("most"))
    at = lambda k, side: F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{k}_{side}")
    return spans.groupBy("lang", "source").agg(*(at(k, side) for k, _ in rules.floors for side in ("least", "most")))


def judged(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``measured`` (columns lang, source, m and any others) with boolean ``kept``.

    Null languages and sources are groups of their own. The fences are written to the shared folder; they are
    broadcast only if they are at most BROADCAST_ROWS, else the join shuffles and skewed sources are split.
    """
    limits = written(fences(sketches(measured, rules), rules), "quality-fences")
    right = limits.select(F.col("lang").alias("gm_lang"), F.col("source").alias("gm_source"), F.struct(*(c for c in limits.columns if c not in ("lang", "source"))).alias("gm_limits"))
    if limits.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    met = measured.join(right, F.col("lang").eqNullSafe(F.col("gm_lang")) & F.col("source").eqNullSafe(F.col("gm_source")), "left")
    fits = ~F.col("m.base_failed")
    for k, _ in rules.floors:
        fits &= F.coalesce(F.col(f"m.{k}").between(F.col(f"gm_limits.{k}_least"), F.col(f"gm_limits.{k}_most")), F.lit(False))
    return met.withColumn("kept", fits).drop("gm_lang", "gm_source", "gm_limits")


def quality_filter(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` (text, lang, source and any others) that the rules keep, columns unchanged.

    Null and empty texts have no words and are rejected; very long texts are measured whole; repeated rows are judged
    alike; an empty table gives an empty table. Columns of any other name are carried along, whatever they are called.
    """
    # explode() keeps the optimizer from repeating the measurement wherever one of its fields is used
    packed = docs.select(F.struct(*quoted(docs.columns)).alias("gm_row"), "lang", "source", F.explode(F.array(measure(F.col("text")))).alias("m"))
    # written with the rows, since the fences need all measures before the first row can be judged
    measured = written(packed.where("not m.base_failed"), "quality-rows")
    return judged(measured, rules).where("kept").select("gm_row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every document. Null and empty texts fail the base rules; very long ones
    are measured whole; repeated rows are judged alike and stay; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    measured = written(docs.select("doc_id", "lang", "source", measure(F.col("text")).alias("m")), "quality-measures")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged(measured).select("doc_id", *(F.col(f"m.{k}").alias(k) for k in base), "kept")
