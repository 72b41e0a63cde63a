"""Structure repair, filter audit and token index against brute force, and the odd cases of every input."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmend.llm import filter_audit as fa
from gridmend.llm import structure_repair as sr
from gridmend.llm import token_index as ti

BLANK = " \t\n\x0b\x0c\r"

# structure repair


def hit(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def order(row):
    _, turn, role, text = row
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, role.encode(), text[: sr.PREFIX].encode(), digest)


def brute_repair(rows):
    """One conversation after damage, by a search over all edits from its end."""
    rows = sorted(rows, key=order)
    seen, fault = set(), []
    for _, _, role, text in rows:
        said = text.rstrip(BLANK)
        fault.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, state, inserts):
        found = [(0, ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, letter, j, to, left, turn):
            if to:
                more = best(j, to if to != "-" else state, left)
                if more:
                    found.append((cost + more[0], ((letter, turn), *more[1])))

        if inserts < 2:
            for role in ("user", "assistant"):
                add(2, "I", i, role[0] if role[0] in follows[state] else None, inserts + 1, f"{role}:")
        if i < len(rows):
            _, _, role, text = rows[i]
            add(3, "D", i + 1, "-", 0, None)
            if fault[i] not in ("blank", "duplicate"):
                open_end = fault[i] == "truncated"
                add(open_end, "K", i + 1, initials[i] if initials[i] and initials[i] in follows[state] else None, 0, f"{role}:{text}")
                for new in ("user", "assistant"):
                    add(2 + open_end, "R", i + 1, new[0] if new[0] in follows[state] else None, 0, f"{new}:{text}")
        return min(found, key=lambda x: (x[0], "".join(letter for letter, _ in x[1])), default=None)

    cost, edits = best(0, "", 0)
    text = "\n".join(t for _, t in edits if t is not None)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, "".join(x for x, _ in edits), hashlib.sha256(text.encode()).hexdigest()


def conversations(n, seed):
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "So?", "cut", "", None, " \n", "é. ", f"{rng.random()}.", "x" * 150 + rng.choice("ab")])
            rows += [(conv, rng.choice([turn, turn, turn, turn // 2, turn + 3, None]), role, text)] * rng.choice([1] * 9 + [2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def repair(spark, rows):
    got = sr.digests(sr.repaired(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r.conv_id and int(r.conv_id): tuple(r)[1:] for r in got}


@pytest.mark.parametrize("piece", [1, 3, 20_000])
def test_repair_equals_a_search_over_all_edits(spark, monkeypatch, piece):
    monkeypatch.setattr(sr, "PIECE", piece)
    rows = conversations(40 if piece > 1 else 12, piece)
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = brute_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv])
    assert repair(spark, rows) == want


def test_a_conversation_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(sr, "PIECE", 7)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"{t}.", f"{t}", ""])) for t in range(150)]
    assert repair(spark, rows) == {1: brute_repair(rows)}


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in (1, None) for t in [*range(60), None]]
    got = sorted(map(repr, map(tuple, sr.damaged(spark.createDataFrame(rows, SCHEMA)).collect())))
    want = []
    for c, t, role, text in rows:
        h = hit(c, t)
        want += [(c, t, "user" if h == 4 else role, {1: "", 2: "A b c"}.get(h, text))] * {0: 0, 3: 2}.get(h, 1)
    assert got == sorted(map(repr, want)) and {hit(c, t) for c, t, _, _ in rows} >= {0, 1, 2, 3, 4}


def test_repair_query_takes_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None), (1, 1, "user", "Hi."), (2, 5, "assistant", "long " * 50_000), (2, 5, "assistant", "long " * 50_000)]
    rows += [(c + 10, t, r, x) for c, t, r, x in conversations(10, 9) if c is not None]
    gone = next(c for c in range(100, 200) if hit(c, 0) == 0)
    rows.append((gone, 0, "user", "dropped"))
    spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit("clash"), "x.y": F.lit(1)}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in sr.op11_structure_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in got:
        left = []
        for c, t, r, x in rows:
            h = hit(c, t)
            if c == conv and h:
                x = {1: "", 2: re.sub("[.!?]", "", x or " ")}.get(h, " " if x is None else x)
                left += [(c, t, "user" if h == 4 else " " if r is None else r, x)] * (1 + (h == 3))
        if left:
            assert tuple(got[conv])[1:] == brute_repair(left), conv
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert sr.op11_structure_repair(spark, f"{tmp_path}/none").count() == 0


# filter audit


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * capitals > 3 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(0, 300))
def test_masks(text, times):
    text = (text + " ") * (times % 7) + "ab " * times
    assert fa.text_mask(text) == fails(text)


def test_masks_of_long_texts_are_those_of_short_ones(monkeypatch):
    texts = ["", "A b\x0bc\x1cd\xa0e #", "word " * 500, " ".join(map(str, range(400)))]
    short = [fa.text_mask(t) for t in texts]
    monkeypatch.setattr(fa, "LONG", -1)
    assert [fa.text_mask(t) for t in texts] == short == [fails(t) for t in texts]


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        older = any(t == (text or "") and j < i for j, t in ((j, t or "") for j, t, _ in docs if j is not None)) if i is not None else False
        rows.append((lang or "", fails(text or "") + 16 * older, i in good and i is not None, i in toxic and i is not None))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for perm in itertools.permutations(range(5)):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(perm):
                failing = sum(r[0] == part and r[1] >> f & 1 for r in rows)
                gone = [r for r in left if r[1] >> f & 1]
                left = [r for r in left if not r[1] >> f & 1]
                alone = sum(r[0] == part and r[1] == 1 << f for r in rows)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, "".join("ABCDE"[x] for x in perm), k + 1, len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def test_audit_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    pool = ["", None, "few WORDS", "a # b", "same " * 300, " ".join(map(str, range(250))), "W " + " ".join(map(str, range(250))), " \n", "é" * 9]
    docs = [(rng.choice([None, *range(60)]), rng.choice(pool), rng.choice(["en", "fr", None, ""])) for _ in range(150)]
    docs += [docs[0]] * 20 + [(7, "few WORDS", "en")] * 5 + [(99, "word " * 300_000, "de")]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit("clash"), "x.y": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(tuple, fa.op12_filter_audit(spark, str(tmp_path)).collect())) == brute_audit(docs, labels)
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert fa.op12_filter_audit(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_meet_each_order_once(n):
    order = list(range(n))
    met = [tuple(order)]
    for i in fa.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        met.append(tuple(order))
    assert sorted(met) == sorted(itertools.permutations(range(n)))


# token index

FILE = ti.read_tokenizer()
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab'sdr e<|endoftxstarf>.,é İ\t\n1#", max_size=60)))
def test_ids_are_the_librarys(text):
    codec = ti.WordIds.of(FILE)
    for _ in range(2):  # without and with its words in the cache
        assert np.frombuffer(codec.encode(text), "<u2").tolist() == ids_of(text)[:-1]


def test_full_caches_start_again(monkeypatch):
    monkeypatch.setattr(ti, "CACHE_WORDS", 3)
    codec = ti.WordIds(FILE)
    for text in ["a b c d e", "f g h", "it's they're 12 x-y", "<|endoftext|> z", "ends."]:
        assert np.frombuffer(codec.encode(text), "<u2").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_hash_is_perfect_and_minimal(n):
    h = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    words, sizes, slot, left = ti.perfect_hash(h)
    assert sorted(slot) == list(range(n)) and not len(left)
    assert (ti.slots(h, words, sizes) == slot).all()
    assert n < 5000 or len(words) * 64 < 4 * n


def test_equal_hashes_are_listed():
    h = np.array([5, 5, 6, 7, 5], np.uint64)
    words, sizes, slot, left = ti.perfect_hash(h)
    assert sorted(slot) == list(range(5)) and sorted(left) == [0, 1, 4] and sorted(slot[left]) == [2, 3, 4]


DOCS = [(i * 3, t) for i, t in enumerate(["", None, "one", "two words", "# hash", "It's <|endoftext|> here", "é ü 12", "x" * 5000, "many " * 3000])]
DOCS += [(None, "no id"), (None, None), (4, "b"), (4, "a"), (-(2**63), "least")] + [(4, "same")] * 40 + [(2**62, "last")]


@pytest.mark.parametrize("ranged", [True, False])
def test_files_hold_all_ids_in_order_and_keys_find_them(spark, tmp_path, monkeypatch, ranged):
    folder = f"file://{tmp_path}/tokens"
    ti.write_ids(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), folder, shard_ids=50)
    ti.build_index(spark, folder, row_keys=7)
    keys = ti.entries(spark, folder).select("doc_id", "copy")
    absent = spark.createDataFrame([(1, 0), (4, 42), (None, 2), (10**9, 0)], "doc_id long, copy long")
    found = ti.lookup(spark, folder, keys.union(keys).union(absent))
    got = sorted(ti.read_ids(spark, folder, found, ranged).collect(), key=lambda r: r.start)
    assert len(got) == len(DOCS)
    assert [r.doc_id for r in got] == sorted([d for d, _ in DOCS], key=lambda d: (d is not None, d or 0))
    assert [(r.start, r.n) for r in got] == [(sum(x.n for x in got[:k]), len(r.ids) // 4) for k, r in enumerate(got)]
    read = sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert read == sorted((d is not None, d or 0, ids_of(t)) for d, t in DOCS)
    for doc_id in {d for d, _ in DOCS}:
        assert sorted(r.copy for r in got if r.doc_id == doc_id) == list(range(sum(d == doc_id for d, _ in DOCS)))
    raw = {r.shard: r.content for r in ti.shards(spark, folder, "ids", "content").collect()}
    assert b"".join(raw[s] for s in sorted(raw)) == b"".join(np.frombuffer(r.ids, "<u4").astype("<u2").tobytes() for r in got)
    assert len(raw) > 4


def test_index_query_equals_the_library(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    at, want = 0, []
    for d, t in sorted((r.doc_id, r.text) for r in docs):
        ids = ids_of(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, ti.op13_token_index(spark, small).collect())) == want
    spark.createDataFrame([], "doc_id long, text string").withColumn("x.y", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    assert ti.op13_token_index(spark, str(tmp_path)).count() == 0


def test_end_ids_that_a_separator_cannot_write(spark, tmp_path):
    with pytest.raises(ValueError, match="end id"):
        ti.write_ids(spark.createDataFrame([(1, "a")], "doc_id long, text string"), f"{tmp_path}/x", end_id=49407)
