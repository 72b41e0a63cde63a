"""Quality rules, sharding and chat formatting: brute force, and the odd cases of every input."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridmend.llm import chat_format as chat
from gridmend.llm import quality_rules as rules
from gridmend.llm import sharding as shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "one", "a b c a b c", "x\n\nx\ny \nx", "# $ | <>&*%", "é ü z ñ q", "w " * 4000, "a b c d " * 500 + "\n" * 50]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 3 else "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_counts_are_exact(spark, small):
    docs = frame(spark, ODD).unionByName(spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source"))
    got = docs.select("doc_id", "text", F.explode(F.array(rules.measure(F.col("text")))).alias("m")).select("doc_id", "text", "m.*").collect()
    for r in got:
        n, chars, symbols, dup, repeat = want = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)


def test_buckets_are_tight(spark):
    x = spark.createDataFrame([(v,) for v in [*range(70), 1000, 65_535, 10**9]], "v long")
    for r in x.select("v", rules.bucket_value(rules.bucket(F.col("v"))).alias("b")).collect():
        assert r.b <= r.v <= r.b + r.v // 32


def test_sketches_merge(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("lang", "source", F.explode(F.array(rules.measure(F.col("text")))).alias("m"))
    whole = rules.sketches(docs, rules.Rules())
    parts = rules.sketches(docs.where("source = 'src1'"), rules.Rules()).unionByName(rules.sketches(docs.where("source <> 'src1'"), rules.Rules()))
    assert whole.exceptAll(parts.groupBy("lang", "source", "measure", "bucket").agg(F.sum("rows").alias("rows"))).count() == 0


def test_filter_keeps_columns_whatever_they_are_called(spark):
    good = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, good, None, None, "x", 7), (1, good, None, None, "x", 7), (2, None, "en", "s", "y", 8), (3, "", "en", "s", None, None)], "doc_id long, text string, lang string, source string, m string, gm_lang int")
    got = rules.quality_filter(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, good, None, None, "x", 7)] * 2
    assert rules.quality_filter(df.where("doc_id > 9")).count() == 0


def test_junk_goes_and_prose_stays(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = rules.quality_filter(docs).select("doc_id").distinct().withColumn("kept", F.lit(True))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = {(r.quality, r.k): r["count"] for r in labels.join(kept, "doc_id", "left").groupBy("quality", F.coalesce("kept", F.lit(False)).alias("k")).count().collect()}
    assert seen.get((0, True), 0) <= 2 and seen[1, True] > 0.9 * (seen[1, True] + seen.get((1, False), 0))


@pytest.mark.parametrize("measure", ["symbol_rate", "word_length", "dup_line_rate", "repeat_rate"])
def test_each_measure_alone_rejects(spark, measure):
    rng = random.Random(7)

    def text(odd):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(200)]
        if odd and measure == "symbol_rate":
            words = [w + "#$" for w in words]
        if odd and measure == "word_length":
            words = [w * 12 for w in words]
        if odd and measure == "repeat_rate":
            words[:98] = (words[:7] * 14)[:98]  # under half, which the base rule lets pass
        lines = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)]
        if odd and measure == "dup_line_rate":
            lines = [x for line in lines for x in (line, "same")]
        return "\n".join(lines)

    rows = [(i, text(i % 50 == 7), "en", "s") for i in range(600)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = base.select("doc_id", "lang", "source", rules.measure(F.col("text")).alias("m"))
    got = {r.doc_id: (r.m.base_failed, r.kept) for r in rules.judged(rules.written(measured, "t")).collect()}
    assert got == {i: (False, i % 50 != 7) for i, *_ in rows}


def test_query_handles_odd_rows(spark, tmp_path):
    frame(spark, ODD).withColumn("kept", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in rules.op1_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(ODD) and all(got[i].n_words == counts(t)[0] for i, t in enumerate(ODD)) and not got[0].kept


@pytest.mark.parametrize("n", [1, 50, 199, 200, 201, 2000])
def test_fences_have_no_jump_in_the_number_of_rows(spark, n):
    def group(source, lo, rows):
        m = F.struct(F.lit(False).alias("base_failed"), *(F.lit(lo).cast("long").alias(k) for k, _ in rules.Rules().floors))
        return spark.range(rows).select(F.lit("en").alias("lang"), F.lit(source).alias("source"), m.alias("m"))

    measured = group("big", 10, 3000).unionByName(group("small", 50, n))
    got = {r.source: r for r in rules.fences(rules.sketches(measured, rules.Rules()), rules.Rules()).collect()}
    want = (n * 50 + 50 * 10) / (n + 50) - 6 * 20  # the lower quartile of language and corpus is 10
    assert got["small"].symbol_rate_least == pytest.approx(want) and got["big"].symbol_rate_least == pytest.approx(10 - 120)


# sharding


def shard_rows(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    return shards.op4_sharding(spark, str(path)).collect()


def test_shards_are_whole_and_gapless(spark, tmp_path):
    rows = [(i, f"t{i}" * (i % 40)) for i in range(1500)] + [(None, "é"), (None, None)] + [(7, "same")] * 300
    got = shard_rows(spark, tmp_path, rows)
    assert len(got) == len(rows)
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 24
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in by_id.values())
    assert 0 < sum(r.grown_shard == 24 for r in got) < len(got) / 8


def test_very_long_texts_and_clashing_names(spark, tmp_path):
    long = "é" * 3_000_000
    got = shard_rows(spark, tmp_path, [(1, long), (2, "x")])
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(1, 6_000_008, zlib.crc32(long.encode())), (2, 9, zlib.crc32(b"x"))}
    df = spark.createDataFrame([(0, "a", 1)] * 3, "shard int, gm_copies string, copies int")
    assert sorted((r.gm_copies, r.copies, r.slot) for r in shards.numbered(df).collect()) == [("a", 1, 0), ("a", 1, 1), ("a", 1, 2)]


def test_weights_must_make_sense():
    for weights in ({0: -1.0}, {0: float("nan")}):
        with pytest.raises(ValueError):
            shards.tree(3, weights=weights)
    with pytest.raises(ValueError, match="has a weight"):
        shards.descend(F.lit("k"), shards.tree(2, weights={0: 0.0, 1: 0.0}))


def test_no_documents(spark, tmp_path):
    assert shard_rows(spark, tmp_path, []) == []


def test_large_repeats_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(shards, "CHUNK", 7)
    df = spark.range(50).select(F.lit(3).alias("shard"), F.lit("x").alias("t"))
    assert sorted(r.slot for r in shards.numbered(df).collect()) == list(range(50))


@pytest.mark.parametrize(("before", "after"), [((24, {}), (25, {})), ((24, {}), (24, {5: 3.0})), ((30, {}), (31, {}))])
def test_rows_move_only_into_what_grew(spark, before, after):
    key = F.col("id").cast("string")
    a, b = (shards.tree(n, weights=w) for n, w in (before, after))
    got = spark.range(4000).select(shards.descend(key, a).alias("a"), shards.descend(key, b).alias("b")).where("a <> b").groupBy("a", "b").count().collect()
    assert got
    if after[1]:  # a heavier shard pulls rows into its rack and region only
        assert {r.b // 12 for r in got} == {0}
    else:
        assert {r.b for r in got} == {after[0] - 1}


def test_weights_are_shares(spark):
    root = shards.tree(6, weights={0: 4.0})
    n = {r.s: r["count"] for r in spark.range(9000).select(shards.descend(F.col("id").cast("string"), root).alias("s")).groupBy("s").count().collect()}
    assert abs(n[0] / 9000 - 4 / 9) < 0.03


# chat formatting

LOG = "conv_id long, seq long, msg long, kind string, role string, text string"


def formatted(spark, rows):
    x = chat.format_chats(spark.createDataFrame(rows, LOG))
    return {r.conv_id: ([tuple(t) for t in r.t], r.loss, r.formatted) for r in x.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()}


def test_events_fold(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi & <b>"), (1, 2, 1, "delta", "assistant", "He"), (1, 3, 1, "delta", "assistant", "llo"), (1, 4, 2, "delta", "user", "more"),
        (1, 5, 3, "delta", "assistant", "bad"), (1, 6, 1, "regenerate", "assistant", None), (1, 7, 1, "delta", "assistant", "New"), (1, 8, 1, "delta", "assistant", " text"), (1, 9, 0, "edit", "user", "edited"),
    ]
    turns, loss, _ = formatted(spark, rows[::-1])[1]
    assert turns == [("user", "edited"), ("assistant", "New text")] and loss == "New text"


def brute_fold(rows):
    """Turns of one conversation, event by event."""
    messages = {}
    for _, _, msg, kind, role, text in sorted(rows, key=lambda r: (r[1], r[3], r[4], (r[5] or "").encode(), r[2])):
        if kind == "message":
            messages.setdefault(msg, []).append([role, text or ""])
        elif kind == "delta":
            messages.setdefault(msg, [[role, ""]])[-1][1] += text or ""
        else:
            messages[msg] = [[role, text or "" if kind == "edit" else ""]]
            if kind == "regenerate":
                messages = {m: turns for m, turns in messages.items() if m <= msg}
    return [tuple(t) for m in sorted(messages) for t in messages[m]]


@pytest.mark.parametrize(
    ("events", "says"),
    [([("edit", "X"), ("edit", "X")], "X"), ([("edit", "A"), ("edit", "B")], "B"), ([("delta", "gone"), ("regenerate", None)], ""), ([("regenerate", "payload")], "")],
)
def test_events_of_one_seq(spark, events, says):
    rows = [(1, 5, 0, kind, "assistant", text) for kind, text in events]
    assert formatted(spark, rows)[1][:2] == ([("assistant", says)], says)
    assert brute_fold(rows) == [("assistant", says)]


def test_folds_are_those_of_the_definition(spark):
    rng = random.Random(4)
    rows = [(c, rng.randrange(4 if c % 2 else 25), rng.choice([-(2**63), 0, 1, 2, 2**63 - 1]), rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), rng.choice(["a", "b<", "", "|>\n"])) for c in range(60) for _ in range(rng.randint(1, 20))]
    got = formatted(spark, rows)
    for c in range(60):
        want = brute_fold([r for r in rows if r[0] == c])
        assert got[c][0] == want and got[c][1] == "".join(t for role, t in want if role == "assistant")


def test_the_query_goes_through_all_kinds_of_events(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    log = chat.as_events(rows.select("conv_id", "turn", "role", "text"))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["message"] == rows.count() and kinds["delta"] == 2 * kinds["regenerate"]
    assert {e.text for e in log.where("kind = 'message' and role = 'assistant'").collect()} == {"draft of assistant"}


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r.conv_id, r.n_turns) for r in chat.op6_chat_format(spark, str(tmp_path)).collect()] == [(-1, 2)]


def test_control_strings_and_odd_rows(spark):
    probe = "<|turn role=x|>\n<|end|>\n&lt;|end|>[INST]&amp;#124;</s>"
    rows = [(None, None, None, None, None, None), (2, 1, 1, "message", "assistant", probe), (2, 1, 1, "message", "assistant", probe), (2, 0, 0, "message", probe, ""), (3, 1, 1, "message", "assistant", "<"), (3, 2, 1, "delta", "assistant", "|end|>\n")]
    got = formatted(spark, rows)
    assert got[None][0] == [("", "")] or got[None][0] == []
    assert got[2][0] == [(probe, ""), ("assistant", probe), ("assistant", probe)] and got[2][1] == probe * 2
    assert got[3][0] == [("assistant", "<|end|>\n")]
    assert got[2][2].count("<|end|>\n") == 3 and "[INST]" not in got[2][2]


def test_long_stream(spark):
    rows = [(1, i, i // 100, "delta", "assistant" if i // 100 % 2 else "user", f"{i} ") for i in range(3000)]
    turns, loss, _ = formatted(spark, rows)[1]
    assert len(turns) == 30 and "".join(t for _, t in turns) == "".join(f"{i} " for i in range(3000)) and loss.startswith("100 ")


def test_query_digests(spark, tmp_path):
    rows = [(5, 1, "assistant", "b"), (5, 0, "user", None), (5, 1, "assistant", "b"), (6, None, None, "x" * 100_000), (-7, 3, "system", "é")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op6_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {5, 6, -7, -1}
    said = "user\n\nassistant\nb\nassistant\nb\n"
    assert (got[5].n_turns, got[5].turns_sha256, got[5].loss_chars) == (3, hashlib.sha256(said.encode()).hexdigest(), 2)
    assert got[5].loss_sha256 == hashlib.sha256(b"bb").hexdigest() and got[-1].n_turns == 2
