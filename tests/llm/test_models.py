"""Coding, counting, classifiers and mixing: exact libraries, held-out accuracy, brute force, and odd rows."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gridmend.llm import mixing, quality_classifier, toxicity
from gridmend.llm import sentencepiece_viterbi as sp
from gridmend.llm import token_counts as tc
from gridmend.llm.learning import best_cut, fit_logistic, remainder, sigmoid

ODD = [None, "", " ", "a\nb\n c", "▁x", "\x00y", "🙂 ﬁ Ａ é́", "<s> </s> <|endoftext|>", "word " * 30_000, "x" * 5_000, "don't  stop  now\x85", "中文 русский ελλ ​"]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame([(i if i != 3 else None, t, "en") for i, t in enumerate(ODD)] + [(1, "", "en")] * 2, "doc_id long, text string, lang string")
    df.withColumns({k: F.lit("clash") for k in ("ids", "n_tokens", "score", "source", "gm_row")}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    empty = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    return str(path), str(empty)


# SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sp.Codec.of(sp.Model.read())


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_are_the_librarys(codec, library):
    rng = random.Random(5)
    alphabets = ["abcdefghij", "aaab", "éüß中文 🙂\t\n", "the ing tion", "  ▁ ", "<0x0A>", "0123.,;:!?-_=+*/\\\"'()[]{}", "\x00​ "]
    texts = [t for t in ODD if t] + ["".join(rng.choice(rng.choice(alphabets) + rng.choice(alphabets)) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == library.encode(t), t
        assert codec.decode(ids) == library.decode(ids)


def test_commits_don_t_depend_on_chunks(codec, library):
    rng = random.Random(2)
    for letters in ("abcdeéing▁", "abcdeéing", "▁\na", "xyz\n▁▁"):
        text = "▁" + "".join(rng.choice(letters) for _ in range(3000))
        whole = b"".join(codec.stream([text]))
        assert np.frombuffer(whole, np.int32).tolist() == library.encode(text[1:])
        for size in (1, 7, 250):
            assert whole == b"".join(codec.stream([text[i : i + size] for i in range(0, len(text), size)]))


@pytest.mark.parametrize("words", ["hello▁world", "helloworld"])
def test_commits_come_early(codec, words):
    sent = []

    def letters():
        for i in range(4000):
            sent.append(i)
            yield words[i % len(words)]

    stream = codec.stream(letters())
    assert next(stream) and len(sent) < 200
    for n, _ in enumerate(stream):
        pass
    assert n > 10


def test_encoding_takes_the_windowed_search(library, monkeypatch):
    fresh = sp.Codec(sp.Model.read())
    seen = []
    commit = sp.Codec.commit

    def counted(self, text, begins, last, open_):
        ids, cut = commit(self, text, begins, last, open_)
        seen.append((len(text), len(list(open_)), cut))
        return ids, cut

    monkeypatch.setattr(sp.Codec, "commit", counted)
    text = "some words that stand here once\n" + "and" * 2000 + " end"
    assert fresh.encode(text).tolist() == library.encode(text)
    assert max(n for n, _, _ in seen) <= 8 * fresh.longest  # the window holds, whatever the text's length
    assert sum(n == 1 for _, n, _ in seen) >= 8 and sum(n > 1 and cut > 0 for _, n, cut in seen) > 20


def test_other_models_are_refused():
    def field(number, value):
        return bytes([number << 3 & 127 | 128, number >> 4, value]) if number > 15 else bytes([number << 3, value])

    def model(trainer, normalizer=field(3, 1) + field(4, 0)):
        return bytes([2 << 3 | 2, len(trainer)]) + trainer + bytes([3 << 3 | 2, len(normalizer)]) + normalizer

    good = field(3, 2) + field(35, 1)
    assert sp.refused(model(good)) is None
    assert "byte pairs" in sp.refused(model(field(3, 1) + field(35, 1))) and "single bytes" in sp.refused(model(field(3, 2)))
    assert "after words" in sp.refused(model(good + field(24, 1))) and "normalises" in sp.refused(model(good, field(3, 1)))
    assert "user" in sp.refused(bytes([1 << 3 | 2, 2]) + field(3, 4) + model(good))


def test_sentencepiece_query(spark, documents, library):
    got = sp.op2_sentencepiece(spark, documents[0]).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        r = by[i if i != 3 else None]
        assert r.ids == library.encode(t or "") and r.n_ids == len(r.ids) and r.exact == ("▁" not in (t or ""))
    assert sp.op2_sentencepiece(spark, documents[1]).count() == 0


def test_columns_of_the_same_name_are_replaced(spark):
    df = spark.createDataFrame([("a b", "old")], "text string, ids string")
    both = sp.decode_column(sp.encode_column(df, sp.Model.read()), sp.Model.read())
    assert both.columns == ["text", "ids", "decoded"] and both.first().decoded == "a b"


# token counts


def test_counts_are_the_librarys(spark, documents, small):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for path in (documents[0], small):
        texts = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
        want = sorted(((-1 if i is None else i), len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
        got = tc.op7_token_counts(spark, path).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tc.op7_token_counts(spark, documents[1]).count() == 0


def test_the_head_start_changes_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    a = tc.count_tokens(docs, sample_rows=5).select("doc_id", "n_tokens")
    assert a.exceptAll(tc.count_tokens(docs).select("doc_id", "n_tokens")).count() == 0


def test_other_tokenizers_count_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    df = spark.createDataFrame([("Hello There  world",), (None,)], "text string")
    got = {r.text: r.n_tokens for r in tc.count_tokens(df, path).collect()}
    assert got == {"Hello There  world": len(whole.encode("Hello There  world", add_special_tokens=False).ids), None: 0}


# toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), new[j] + 1, row[j + 1] + 1))
        row = new
    return row[-1]


def test_automaton_finds_all_words_within_the_distance():
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)}
    trie = toxicity.build_trie(words)
    for _ in range(150):
        q = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        for k in (0, 1, 2):
            assert sorted(toxicity.within(trie, q, k)) == sorted((d, w) for w in words if (d := edit_distance(q, w)) <= k)


def test_pieces_lose_no_word():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(40)}
    for k in (1, 2):
        pieces = toxicity.Pieces(words, k)
        for _ in range(400):
            q = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
            if any(edit_distance(q, w) <= k for w in words):
                assert pieces.may(q)


def test_misspelled_and_quoted_words():
    lex = toxicity.Lexicon({"stupid": 5.0, "moron": 5.0}, frozenset({"stupor"}))
    assert lex.look_up("stupid") == (5.0, 0) and lex.look_up("stup1d") == (5.0, 1) and lex.look_up("stupor") is None and lex.look_up("cat") is None
    direct, misspelled, quoted = lex.features("you stupid stup1d thing")[:3]
    assert direct > 0 and misspelled > 0 and quoted == 0
    assert lex.features('they called "stupid" a word')[2] > 0 and lex.features("“ a stupid b ”")[0] == 0


def plain_features(lexicon, text):
    """The features by definition: every word against every lexicon word, every hit's context by scanning it."""
    text = text.lower()
    spans = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    direct = misspelled = quoted = top = 0.0
    known = {}
    for i, (w, start, end) in enumerate(spans):
        if w not in known:
            known[w] = None
            if w in lexicon.odds:
                known[w] = (0, -lexicon.odds[w])
            elif w not in lexicon.clean:
                near = [(edit_distance(w, x), -odds) for x, odds in lexicon.odds.items() if abs(len(w) - len(x)) <= toxicity.edits_for(x)]
                allowed = [toxicity.edits_for(x) for x in lexicon.odds if abs(len(w) - len(x)) <= toxicity.edits_for(x)]
                known[w] = min((n for n, k in zip(near, allowed, strict=True) if n[0] <= k), default=None)
        if known[w] is None:
            continue
        edits, odds = known[w]
        around = spans[max(0, i - 6) : i + 7]
        left = text[spans[i - 7][2] if i > 6 else 0 : start]
        right = text[end : spans[i + 7][1] if i + 7 < len(spans) else len(text)]
        marks = "\"“”„«»"
        if (any(c in marks for c in left) and any(c in marks for c in right)) or any(x in toxicity.REPORTING for x, _, _ in around):
            quoted -= odds
        elif edits:
            misspelled -= odds
        else:
            direct -= odds
            top = max(top, -odds)
    return [np.log1p(direct), np.log1p(misspelled), np.log1p(quoted), top, direct / max(len(spans), 1) ** 0.5]


def test_toxicity_scores_are_those_of_the_definition(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels, remainder(5) != 0)
    assert len(lexicon.odds) >= 5
    twisted = [w[:2] + w[3:] + " " + w[:1] + "#" + w[1:] + f' he said "{w}" ' + w[:-1] + "q" for w in sorted(lexicon.odds)[:40]]
    rows = [(r.text,) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(t,) for t in twisted] + [(None,), ("",)]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "text string"), lexicon).collect()
    assert len(got) == len(rows)
    for r in got:
        x = plain_features(lexicon, r.text or "")
        assert r.score == pytest.approx(float(sigmoid(np.append(x, 1.0) @ lexicon.weights)), abs=1e-9)


def test_a_letter_less_of_a_five_letter_word_is_found():
    lex = toxicity.Lexicon({"moron": 5.0, "fool": 4.0}, frozenset())
    assert lex.look_up("mron") == (5.0, 1) and lex.look_up("morons") == (5.0, 1) and lex.look_up("food") is None


def test_quality_scores_are_those_of_the_definition(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels, remainder(3) != 1)
    rows = [(r.text,) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(None,), ("",)]
    for r in quality_classifier.score_quality(spark.createDataFrame(rows, "text string"), model).collect():
        text = (r.text or "").encode()
        sizes = []
        for part in model.parts:
            z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(part), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(z.compress(text[i : i + 1024])) for i in range(0, max(len(text), 1), 1024)))
        bad, good = sizes
        whole = len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text))
        shrinks, size = np.log((len(text) + 1) / (whole + 1)), np.log(len(text) + 1) / 10
        x = np.array([(bad - good) / max(bad, good), np.log((bad + 20) / (good + 20)), 3 * (bad - good) / (len(text) + 50), shrinks, shrinks**2, size, size**2, shrinks * size])
        assert r.score == pytest.approx(float(sigmoid(np.append((x - model.mean) / model.spread, 1.0) @ model.weights)), abs=1e-9)


def test_the_dictionaries_carry_the_quality_score(spark, tenth):
    docs, labels = (spark.read.parquet(f"{tenth}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels, remainder(3) != 1)
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").where(remainder(3) == 1).select("text", "quality").collect()
    x, y = np.array([model.features((r.text or "").encode()) for r in rows]), np.array([r.quality for r in rows])

    def auc(score):
        rank = np.empty(len(score))
        rank[np.argsort(score, kind="stable")] = np.arange(len(score))
        return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())

    assert auc(x[:, 0]) > 0.97 and abs(auc(x[:, 5]) - 0.5) < 0.1


def test_a_dictionary_of_few_texts_is_made_of_whole_ones():
    few = [b"one text", b"another", b"x" * 200_000, b"last"]
    assert quality_classifier.dictionary(few).as_bytes() == b"one text\nanother\nlast"


@pytest.fixture(scope="module")
def tenth():
    return "/root/testdata/sf0.1"


def held_out(spark, query, folder, label):
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    rows = query(spark, folder).join(labels, "doc_id").where("held_out").collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])


def test_toxicity_held_out(spark, tenth):
    score, label, predicted = held_out(spark, toxicity.op9_toxicity, tenth, "toxic")
    assert predicted[label == 1].mean() >= 0.9
    assert ((score >= 0.5) == predicted).all() and (predicted == label).mean() > 0.97 and (predicted[label == 0] == 1).mean() < 0.005


def test_quality_held_out(spark, tenth):
    score, label, predicted = held_out(spark, quality_classifier.op10_quality_classifier, tenth, "quality")
    assert (score.min() >= 0) and (score.max() <= 1) and (predicted == label).mean() > 0.97 and (predicted[label == 1] == 0).mean() < 0.01


@pytest.mark.parametrize("query", [toxicity.op9_toxicity, quality_classifier.op10_quality_classifier])
def test_odd_rows_are_scored(spark, documents, query):
    got = query(spark, documents[0]).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert query(spark, documents[1]).count() == 0


def test_held_out_rows_are_those_asked_for(spark):
    import zlib

    df = spark.range(40).select(F.col("id").alias("doc_id"), remainder(5).alias("r"))
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 5 for r in df.collect())


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < sigmoid(2 * x[:, 0] - x[:, 1] + 0.5)).astype(float)
    assert fit_logistic(x, y, 1e-3) == pytest.approx([2, -1, 0.5], abs=0.2)
    assert 0.2 < best_cut(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.8


def test_quality_filter_keeps_columns(spark):
    df = spark.createDataFrame([(1, "fine words here", "x")], "doc_id long, text string, gm_score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.classify_filter(df, labels, remainder(3) != 1, 0.5).collect() == df.collect()


# mixing


def test_rates_reach_the_targets(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id")
    classifier = mixing.fit_classifier(docs, labels)
    targets = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    table = mixing.written(mixing.members(docs, classifier), "test-members")
    mix = mixing.fit_rates(table, classifier, targets)
    rows = table.collect()
    n, p = np.array([r.n for r in rows], float), np.array([r.p for r in rows])
    rate = mix.rates(p)
    assert (rate >= 0).all() and (n * rate) @ p / n.sum() == pytest.approx(mix.targets, abs=5e-4)
    # the same steps with the rates kept as they are
    push, x, point, shares = np.linalg.inv((p * n[:, None]).T @ p / n.sum()), np.ones(len(n)), np.ones(len(n)), None
    for beta, _ in zip(mixing.momentum(0, len(mix.pushes)), mix.pushes, strict=True):
        shares = (n * point) @ p / n.sum()
        new = np.maximum(0, point - p @ push @ (shares - mix.targets))
        point, x = new + beta * (new - x), new
    assert rate == pytest.approx(x, abs=1e-6)


@pytest.mark.parametrize("shares", [(0.6, 0.3, 0.099, 0.001), (0.989, 0.01, 0.001), (0.6, 0.3, 0.095, 0.005), (0.97, 0.02, 0.01)])
def test_rare_domains_reach_the_targets(spark, shares):
    rng = np.random.default_rng(4)
    d, rows = len(shares), 4000
    of = np.repeat(np.arange(d), np.round(np.array(shares) * rows).astype(int))
    p = np.full((len(of), d), 0.01 / (d - 1))
    p[np.arange(len(of)), of] = 0.99
    n = rng.integers(50, 150, len(of))
    table = mixing.written(spark.createDataFrame(list(zip(n.tolist(), p.tolist(), strict=True)), "n long, p array<double>"), "test-rare")
    mix = mixing.fit_rates(table, mixing.Classifier([f"d{i}" for i in range(d)], np.zeros(d), np.zeros((d, 1))))
    rate = mix.rates(p)
    assert (rate >= 0).all() and (n * rate) @ p / n.sum() == pytest.approx(np.full(d, 1 / d), abs=5e-4)
    assert mix.residual < mixing.ENOUGH


def test_soft_posteriors_reach_targets_too(spark):
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet([3.0, 0.3, 0.3, 0.3], 3000), rng.integers(50, 150, 3000)  # a third of the rates become 0
    table = mixing.written(spark.createDataFrame(list(zip(n.tolist(), p.tolist(), strict=True)), "n long, p array<double>"), "test-soft")
    mix = mixing.fit_rates(table, mixing.Classifier(list("abcd"), np.zeros(4), np.zeros((4, 1))))
    rate = mix.rates(p)
    assert (rate == 0).mean() > 0.1 and (n * rate) @ p / n.sum() == pytest.approx(np.full(4, 0.25), abs=5e-4)


def test_targets_of_unknown_domains_are_errors(spark):
    table = spark.createDataFrame([(10, [0.9, 0.1])], "n long, p array<double>")
    with pytest.raises(ValueError, match="xx"):
        mixing.fit_rates(table, mixing.Classifier(["a", "b"], np.zeros(2), np.zeros((2, 1))), {"a": 0.5, "xx": 0.5})


def test_targets_out_of_reach_are_reported(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PATIENCE", 10)
    table = mixing.written(spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.6, 0.4])], "n long, p array<double>"), "test-far")
    with pytest.warns(UserWarning, match="targets aren't met"):
        mix = mixing.fit_rates(table, mixing.Classifier(["a", "b"], np.zeros(2), np.zeros((2, 1))), {"b": 1.0})
    assert mix.residual > 0.1 and np.isfinite(mix.rates(np.array([[0.9, 0.1], [0.6, 0.4]]))).all()


def test_copies_follow_the_rates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = mixing.op5_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == docs.count() and all(abs(r.copies - r.rate) < 1 for r in got)
    assert sum(r.copies for r in got) == pytest.approx(sum(r.rate for r in got), rel=0.1)
    right = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.domain == right[r.doc_id] for r in got]) > 0.97


def test_shares_are_equal_on_expectation(spark):
    total = {}
    for r in mixing.op5_mixing(spark, "/root/testdata/sf0.01").collect():
        total[r.domain] = total.get(r.domain, 0) + r.rate * r.n_tokens
    assert len(total) == 4 and max(total.values()) / min(total.values()) < 1.05


@pytest.mark.parametrize("many", [70, 300])
def test_all_domains_are_fitted(spark, many):
    rows = [(200 * d + k, " ".join(f"w{d}x{(k + j) % 9}" for j in range(30)), f"l{d:03}") for d in range(many) for k in range(4 if d else 120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    classifier = mixing.fit_classifier(docs, labels, rows=3 * many)
    assert classifier.domains == [f"l{d:03}" for d in range(many)]
    assert {r.doc_id // 200 for r in mixing.mixed(docs, labels).collect() if r.domain == f"l{r.doc_id // 200:03}"} == set(range(many))
    table = mixing.written(mixing.members(docs, classifier), "test-members")
    mix, members = mixing.fit_rates(table, classifier), table.collect()
    n, p = np.array([r.n for r in members], float), np.array([r.p for r in members])
    assert mix.residual < mixing.ENOUGH and (n * mix.rates(p)) @ p / n.sum() == pytest.approx(np.full(many, 1 / many), abs=5e-4)


def test_the_column_of_other_documents_is_never_looked_at(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id")
    known = docs.join(labels.distinct().withColumn("is_known", F.lit(True)), "doc_id", "left")
    hidden = known.select("doc_id", "text", F.when(F.col("is_known"), F.col("lang")).otherwise("xx").alias("lang"))
    rows = lambda df: sorted((r.doc_id, r.domain, round(r.rate, 6)) for r in mixing.mixed(df, labels).collect())
    assert rows(docs) == rows(hidden) and hidden.where("lang = 'xx'").count() > 100


def test_tokens_are_words_letters_or_given(spark):
    read = mixing.Classifier(["a"], np.zeros(1), np.zeros((1, mixing.BUCKETS))).read
    assert read("two words")[0] == 2 and read("中文字 かな")[0] == 5 and read("abc中")[0] == 2 and read("")[0] == 0
    df = spark.createDataFrame([(1, "a b", "en", 7), (2, "c", "en", None)], "doc_id long, text string, lang string, n_ids int")
    got = mixing.mixed(df, df.select("doc_id"), tokens="n_ids").collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 7, 2: 1}


def test_carried_rates_are_the_replayed_ones():
    rng = np.random.default_rng(3)
    p, pushes = rng.dirichlet(np.ones(3), 50), list(rng.normal(size=(25, 3)) / 9)
    rate = point = None
    for k in range(0, 25, 10):
        rate, point = mixing.replay(p, pushes[k : k + 10], k, rate, point)
    assert np.allclose((rate, point), mixing.replay(p, pushes))


def test_mixing_odd_rows(spark, documents):
    got = mixing.op5_mixing(spark, documents[0]).collect()
    assert len(got) == len(ODD) + 2 and all(r.rate >= 0 for r in got)
    assert mixing.op5_mixing(spark, documents[1]).count() == 0
    df = spark.createDataFrame([(1, "a", "en", 5), (None, None, None, None)], "doc_id long, text string, lang string, gm_copies int")
    assert mixing.mix_rows(df, spark.createDataFrame([(1,)], "doc_id long")).columns == df.columns
    with pytest.raises(ValueError):
        mixing.mix_rows(df, spark.createDataFrame([(1,)], "doc_id long"), {"xx": 1.0})


def test_the_classifier_sends_each_text_once(spark, monkeypatch):
    """What goes to Python is the row alone, in which the text is looked up, whatever its place and whichever columns are beside it."""
    from gridmend.llm import quality_classifier as qc

    sent, real = [], qc.appended
    monkeypatch.setattr(qc, "appended", lambda df, *more: sent.append(df.columns) or real(df, *more))
    docs = spark.createDataFrame([(i, None if i == 7 else f"some words {i} " * (1 + i % 5), "en") for i in range(1200)], "doc_id long, Text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = qc.fit(docs, labels, F.lit(True))
    want = {r.doc_id for r in qc.score_quality(docs, model).where("score >= 0.5").collect()}
    sent.clear()
    kept = qc.classify_filter(docs, labels, F.lit(True), 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and 0 < len(want)
    assert sent == [["gm_row"]]
