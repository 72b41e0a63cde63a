"""Near duplicates of texts and vectors against all pairs, components, and the pipeline."""

import collections
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmend.llm import embedding_dedup as emb
from gridmend.llm import minhash_dedup as mh
from gridmend.llm import mixing, oracles, quality_classifier
from gridmend.llm.common import written
from gridmend.llm.graph import components
from gridmend.llm.learning import remainder


def classes(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_pairs(texts):
    sets = [grams(t) for t in texts]
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    shared = collections.Counter((a, b) for x in where.values() for k, b in enumerate(x) for a in x[:k])
    return [(a, b) for (a, b), c in shared.items() if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8]


@pytest.fixture(scope="module")
def copies():
    """A hub with copies at every distance, exact copies, chains, and odd texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 90))) for _ in range(60)]
    for k in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words) + "x"
        texts.append(" ".join(w))
    chain = [rng.choice(words) for _ in range(120)]
    for k in range(12):
        chain = chain[3:] + [rng.choice(words) for _ in range(3)]
        texts.append(" ".join(chain))
    texts += ["one", "one", " one\n", None, None, "", " ", "a b c d", "long " + "z y " * 20_000, "long " + "z y " * 20_000]
    rng.shuffle(texts)
    return texts


def test_classes_are_those_of_all_pairs(spark, copies, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 64)
    pairs = similar_pairs(copies)
    want = classes(len(copies), pairs)
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in mh.near_duplicates(df).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(want) - 150


def test_large_bands_are_solved_in_tiles(spark, copies):
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    marked = written(mh.prints(df), "t")
    near = mh.shared_bands(marked)
    assert mh.tile_rows(near, spark.createDataFrame([], "node binary, root binary"), 20).where("kind = 1 and i <> j").count() > 0
    a = components(mh.links(df, marked, 20))
    assert a.exceptAll(components(mh.links(df, marked, 4096))).count() == 0


def test_tiles_alone_find_all_links(spark, copies):
    """Without the first turn, so that every link must come from the tiles."""
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    marked = written(mh.prints(df), "t")
    near = mh.shared_bands(marked)
    texts = written(mh.texts_of(df), "t").dropDuplicates(["h"])
    none = spark.createDataFrame([], "node binary, root binary")
    for block in (30, 1000):
        found = components(mh.tiled_links(near, texts, none, block))
        firsts = marked.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("i")).join(found, F.col("h") == F.col("node")).collect()
        least = {}
        for r in firsts:
            least[r.root] = min(least.get(r.root, r.i), r.i)
        want = classes(len(copies), similar_pairs(copies))
        assert all(want[r.i] == least[r.root] for r in firsts) and len(firsts) > 120


def test_copies_with_a_repeated_passage_are_linked(spark):
    texts = []
    for k in range(12):
        words = [f"t{k}w{i}" for i in range(300)]
        size, times = ((40, 20), (50, 16))[k % 2]
        texts += [" ".join(words), " ".join(words + [f"t{k}p{i}" for i in range(size)] * times)]
    want = classes(len(texts), similar_pairs(texts))
    assert want == [i // 2 * 2 for i in range(len(texts))]
    got = mh.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(want))


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (3, text + " ", 2), (3, text + " ", 2), (9, text.replace("w7", "v7"), 3), (None, None, 4), (8, None, 5), (8, "", 6), (2, "other words entirely", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gm_key int")
    got = mh.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.gm_key) for r in got.collect() if (r.text or "").strip()) == [(2, 7), (3, 2)]
    assert {r.doc_id for r in got.collect()} == {3, None, 8, 2}
    assert mh.drop_near_duplicates(df.where("false")).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a, b = ({int(x): int(c) for x, c in zip(rng.integers(0, 2**60, 300), rng.integers(1, 6, 300), strict=True)} for _ in "ab")
    b = {**dict(list(a.items())[:220]), **dict(list(b.items())[:80])}
    for k in list(b)[:60]:
        b[k] += 3

    def arrays(d):
        keys = np.array(sorted(d), np.uint64)
        return keys, np.array([d[int(k)] for k in keys])

    x, y = arrays(a), arrays(b)
    wa, wb = ({k: 1 + np.log2(c) for k, c in d.items()} for d in (a, b))
    exact = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in wa.keys() | wb.keys()) for d in wa.keys() & wb.keys())
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    assert mh.similar(x, y) == pytest.approx(max(exact, plain))
    old = mh.SIZE
    try:
        mh.SIZE = 6000
        s = mh.signatures([x, y])
    finally:
        mh.SIZE = old
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = classes(len(docs), similar_pairs([r.text for r in docs]))
    got = {r.doc_id: r.class_id for r in mh.op3_minhash_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: docs[k].doc_id for r, k in zip(docs, want, strict=True)}


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (50, 51), (51, 50), (51, 52)]
    nodes = sorted({x for p in pairs for x in p})
    at = {n: i for i, n in enumerate(nodes)}
    want = {n: nodes[r] for n, r in zip(nodes, classes(len(nodes), [(at[a], at[b]) for a, b in pairs]), strict=True)}
    assert {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# vectors


def brute(ids, vectors):
    sound = [v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    pairs = []
    for a in range(len(ids)):
        for b in range(a):
            if sound[a] and sound[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], np.float32).astype(float), np.array(vectors[b], np.float32).astype(float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.9:
                    pairs.append((b, a))
    links = collections.Counter(x for p in pairs for x in p)
    top = classes(len(ids), pairs)
    least = collections.defaultdict(list)
    for i, t in enumerate(top):
        least[t].append(ids[i])
    return [(ids[i], links[i], min(least[top[i]])) for i in range(len(ids))]


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    vectors = [(centres[i % 12] + rng.normal(size=24) * rng.choice([0.1, 0.3, 0.36])).tolist() for i in range(400)]
    vectors += [vectors[3]] * 40 + [[2 * c for c in vectors[5]]] + [None, [0.0] * 24, [float("nan")] * 24, [None] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [1.0, 2.1], []]
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").withColumn("links", F.lit(1))
    want = brute(ids, vectors)
    for blocks in (None, 1, 5):
        got = emb.link_vectors(df.select("vec_id", "embedding"), blocks=blocks).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(n for _, n, _ in want) > 1000
    assert emb.link_vectors(df.where("false").select("vec_id", "embedding")).count() == 0


def test_vectors_of_any_size_are_linked(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [5e-324, 5e-324]), (4, [-1e308, 1e308]), (None, [3.0, 6.0]), (6, [1.0, -1.0])]
    got = emb.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (6, 0, 6)]


def test_open_pairs_are_decided_in_full_precision(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16))
    y = rng.normal(size=(300, 16))
    y -= x * ((x * y).sum(axis=1) / (x * x).sum(axis=1))[:, None]
    x, y = (v / np.sqrt((v * v).sum(axis=1))[:, None] for v in (x, y))
    cosine = 0.9 + rng.choice([-1e-6, -1e-9, 1e-9, 1e-6], 300)
    pairs = np.concatenate([x, cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * y])
    got = emb.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>"), blocks=3)
    near = {r.vec_id: r.component_id for r in got.collect()}
    direct = [near[300 + i] == near[i] for i in range(300) if near[i] == i]
    assert direct == [bool(c > 0.9) for i, c in enumerate(cosine) if near[i] == i] and len(direct) > 200


def test_embedding_query_of_odd_tables(spark, tmp_path):
    rows = [(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (2, [1.0, 0.01], 3), (5, None, 4), (None, None, 5), (7, [0.0, 1.0], 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls int").withColumn("n_links", F.lit("clash")).withColumn("HOME", F.lit(1))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = emb.op8_embedding_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (0, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (5, 0, 5, True), (7, 0, 7, True)]
    df.where("false").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert emb.op8_embedding_dedup(spark, f"{tmp_path}/none").count() == 0


def test_blocks_follow_cores_and_memory():
    assert emb.block_count(0, 1, 8) == 1 and emb.block_count(500, 64, 6) == 1
    assert emb.block_count(50_000, 64, 6) == emb.block_count(300_000, 64, 6) == 5
    assert emb.block_count(100_000_000, 64, 4000) == 100_000_000 * 64 // emb.BLOCK_BYTES + 1


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 48)) * rng.lognormal(0, 2, (300, 48))
    unit, code, scale, stands, rest = emb.quantised(x)
    near = emb.product(code, code) * scale[:, None] * scale[None, :]
    assert (np.abs(unit @ unit.T - near) <= stands[:, None] * rest[None, :] + rest[:, None] + 1e-12).all()
    assert code.dtype == np.int8 and np.abs(code.astype(int)).max() == 127


def test_products_are_exact_beyond_one_slice():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-127, 128, (5, 2500)).astype(np.int8) for _ in "ab")
    assert (emb.product(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


# the pipeline


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "t")
        assert docs.columns == columns, name
        seen.append(docs.toPandas())
    rules, quality, dedup, mix = seen
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    verdict = con.execute(f"select doc_id from ({oracles.quality_rules()}) where kept").df()
    assert sorted(rules.doc_id) == sorted(verdict.doc_id)
    whole = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.fit(whole, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), remainder(3) != 1)
    likely = model.score(rules.text.tolist())
    assert sorted(quality.doc_id) == sorted(rules.doc_id[likely >= corpus_pipeline.LEAST_QUALITY]) and len(quality) <= len(rules)
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id").quality
    good = quality.doc_id.map(labels)
    assert (good.dropna() == 1).mean() > 0.98 and len(quality) >= 0.99 * len(rules)
    texts = quality.sort_values("doc_id").text.tolist()
    want = classes(len(texts), similar_pairs(texts))
    assert len(dedup) == len(set(want)) and set(dedup.text) == {texts[i] for i in set(want)}
    assert set(mix.doc_id) <= set(dedup.doc_id)
    rows = mixing.mixed(spark.createDataFrame(dedup[["doc_id", "text", "lang"]]), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id")).toPandas()
    tokens = (rows.rate * rows.n_tokens).groupby(rows.domain).sum()
    assert tokens.max() / tokens.min() < 1.05
    copies = mix.doc_id.value_counts()
    assert all(copies.get(i, 0) == n for i, n in zip(rows.doc_id, rows.copies, strict=True)) and len(mix) == rows.copies.sum()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert len(out) == len(mix) and out.exact.all()


def test_pipeline_of_odd_rows(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, good + " more", None, None, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == [1]
