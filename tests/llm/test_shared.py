"""What the text operators share: settings, the scratch folder, columns of the same name."""

from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmend.llm import common, quality_classifier, token_counts
from gridmend.llm.learning import remainder

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_operators_leave_settings_alone_and_queries_hold_batches(spark, small):
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "9000")
        docs = spark.createDataFrame([("a b",)], "text string")
        token_counts.count_tokens(docs).collect()
        quality_classifier.classify_filter(docs.withColumn("doc_id", F.lit(1)), spark.createDataFrame([], "doc_id long, quality int"), remainder(3) != 1).collect()
        assert spark.conf.get(KEY) == "9000"
        token_counts.op7_token_counts(spark, small)
        assert spark.conf.get(KEY) == "500"
        spark.conf.set(KEY, "20")
        common.small_batches(spark)
        assert spark.conf.get(KEY) == "20"
    finally:
        spark.conf.set(KEY, before)


def test_scratch_is_in_one_folder_and_goes(spark):
    root = common.scratch_root(spark)
    a, b = (common.written(spark.range(3), name) for name in ("one", "two"))
    assert all(f.startswith(root) for f in a.inputFiles())
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    n = len(fs.listStatus(path))
    common.erase(a)
    assert len(fs.listStatus(path)) == n - 1 and b.count() == 3
    common.clear(spark)
    assert not fs.exists(path)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn"])
def test_a_cluster_needs_a_shared_folder(master):
    context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context))


def test_portions_are_small_and_whole():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 3, 1200)]
    got = list(common.portions(iter(batches)))
    assert [b.num_rows for b in got] == [3, 500, 500, 200] and [x for b in got for x in b.column(0).to_pylist()] == [0, 1, 2, *range(1200)]


def test_columns_are_replaced_whatever_their_case(spark):
    df = spark.createDataFrame([("a b", "old")], "text string, N_Tokens string")
    assert common.without(df, "n_tokens") == ["text"]
    got = token_counts.count_tokens(df)
    assert got.columns == ["text", "n_tokens"] and got.first().n_tokens == 2
