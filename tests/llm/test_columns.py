"""Columns of any name are carried along by the operators that keep them, and by the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmend.llm import mixing, minhash_dedup, quality_classifier, quality_rules, sentencepiece_viterbi, sharding, token_counts, toxicity
from gridmend.llm.learning import remainder

NAMES = ["x.y", "a`b", "gm_row", "gm_key", "part", "score 1", "É"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60)), "en", "s") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, Text string, lang string, source string")
    for k, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(k))
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    return df, labels


OPERATORS = {
    "quality": lambda d, _: quality_rules.quality_filter(d),
    "classifier": lambda d, l: quality_classifier.classify_filter(d, l, remainder(3) != 1, 0.0),
    "dedup": lambda d, _: minhash_dedup.drop_near_duplicates(d),
    "mixing": lambda d, l: mixing.mix_rows(d, l),
    "tokens": lambda d, _: token_counts.count_tokens(d),
    "encode": lambda d, _: sentencepiece_viterbi.encode_column(d, sentencepiece_viterbi.Model.read()),
    "toxicity": lambda d, l: toxicity.score_toxicity(d, toxicity.fit(d, l, remainder(5) != 0)),
    "shards": lambda d, _: sharding.numbered(sharding.assign(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, odd, name):
    df, labels = odd
    got = OPERATORS[name](df, labels)
    assert got.columns[: len(df.columns)] == df.columns
    rows = got.collect()
    assert rows and all(list(r)[4 : 4 + len(NAMES)] == list(range(len(NAMES))) for r in rows)


def test_pipeline(spark, odd, tmp_path):
    df, labels = odd
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
