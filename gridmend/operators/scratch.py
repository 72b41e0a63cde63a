"""Intermediate tables in the folder that the cluster shares, and broadcasts behind a check of their size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes, as they are written, up to which a table counts as small.
SMALL, SMALL_BYTES = 100_000, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is set, a local master gets a local one, for tests;
    a cluster is an error, since its executors wouldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='gridmend-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_folder(spark)}/gridmend-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` by way of the shared folder, so that plans don't grow with the rounds of a loop."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erase(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by cut() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = SMALL, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df`` to be broadcast if it has ``most`` rows and its file ``most_bytes`` or fewer; else for Spark to shuffle. It is written
    once, so its size is known before it is used, and it isn't computed a second time."""
    table = cut(df, "small")
    folder = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else None
    if folder:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength() > most_bytes:
            return table
    return F.broadcast(table) if table.count() <= most else table


def narrow(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The same by rows alone, for tables of a few numbers a row that are written already."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
