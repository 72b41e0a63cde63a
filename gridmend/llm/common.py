"""What the text operators share: table reading, the shared scratch folder, and small expression helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SPLIT_AT = r"[\x20\x09-\x0D]+"
#: Bytes of a row group of intermediate tables: a writer holds one in memory, and texts may be in it.
ROW_GROUP = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table, narrowed to the columns that are used, so that extra columns can't clash."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local master gets a local one, for
    tests; a cluster is an error, since its executors wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridmend-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/gridmend-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def erase(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by written() that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. To be called once what the operators returned has been
    written: their results read some of these tables."""
    _delete(spark, scratch_root(spark))


_held: list = []
_libc = ctypes.CDLL(None)


def claim(name: str, drop: Callable[[], None]) -> None:
    """Called by an operator in a Python worker: what another operator has cached there is dropped first, since Spark
    uses a worker for one operator after another."""
    if _held and _held[0] != name:
        _held[1]()
        pa.default_memory_pool().release_unused()
        if hasattr(_libc, "malloc_trim"):
            _libc.malloc_trim(0)  # else what a worker once held stays with it
    _held[:] = [name, drop]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Holds the Arrow batches of a session to few rows, so that executors of 3 GB have room for very long texts.

    Only the registered queries and the pipeline's stages call this, for sessions of their own; operators leave a
    caller's settings alone. A lower setting is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def portions(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that a worker has few texts as Python strings at once. Spark itself holds a
    batch to spark.sql.execution.arrow.maxBytesPerBatch."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def without(df: DataFrame, name: str) -> list[str]:
    """The columns of ``df`` but those that Spark would take for ``name``."""
    return [c for c in df.columns if c.lower() != name.lower()]


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, which may hold dots and back-ticks."""
    return [F.col("`" + n.replace("`", "``") + "`").alias(n) for n in names]


def appended(df: DataFrame, out: str, make: Callable[[], Callable[[pa.RecordBatch], pa.Array]], like: Column) -> DataFrame:
    """``df`` with a column ``out``, of the type of ``like``, that a worker computes from batches; a column of that name is
    replaced. ``make`` is called once in each task. Columns are numbered meanwhile, so that their names may be any."""
    names = without(df, out)
    rows = df.select(*quoted(names)).toDF(*(f"c{i}" for i in range(len(names))))
    own = f"c{len(names)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in portions(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, of(b)], names=[*b.schema.names, own])

    return rows.mapInArrow(run, rows.withColumn(own, like).schema).toDF(*names, out)


def place_of(names: list[str], name: str) -> int:
    """Where the column is that Spark would take for ``name``."""
    return [n.lower() for n in names].index(name.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once and bound to a lambda variable."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """All words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT_AT), "")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
