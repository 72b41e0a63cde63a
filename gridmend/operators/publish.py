"""Series at several resolutions, appended as one (B10, S08): all of an append's tables are there, or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The resolutions of a load series in seconds, by the names of their tables.
RESOLUTIONS = {"quarter": 900, "hour": 3_600, "day": 86_400}


def rolled_up(series: DataFrame, key: str, at: str, value: str, resolutions: Mapping[str, int] = RESOLUTIONS) -> DataFrame:
    """(resolution, key, at, mean, n): the mean of ``value`` in each window of each resolution, from one pass over ``series``.

    All windows of a row are summed before the shuffle together. Null values count for nothing; rows without a time are left out.
    """
    start = lambda s: F.timestamp_seconds(F.floor(F.unix_seconds(at) / s) * s)
    windows = F.array(*(F.struct(F.lit(name).alias("resolution"), start(s).alias("at")) for name, s in resolutions.items()))
    each = series.where(F.col(at).isNotNull()).select(key, F.explode(windows).alias("w"), F.col(value).alias("value"))
    return each.groupBy("w.resolution", key, "w.at").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


class Published:
    """Tables under a folder whose state is the last of its manifests. A manifest names the folders of each table's parts.

    Parts are written first, into folders that no manifest names yet; then one file is renamed into place. An append that ends before
    that, or finds that another one has come first, leaves what was published as it was.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.folder, *parts)))
        self._fs = self._path("manifests").getFileSystem(spark._jsc.hadoopConfiguration())

    def _number(self) -> int:
        where = self._path("manifests")
        if not self._fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def state(self) -> dict[str, list[str]]:
        number = self._number()
        if not number:
            return {}
        (row,) = self.spark.read.text(f"{self.folder}/manifests/{number:09}.json", wholetext=True).collect()
        return json.loads(row.value)

    def append(self, tables: Mapping[str, DataFrame]) -> int:
        """Adds the rows of ``tables``; returns the number of the state that has them all."""
        number, state = self._number(), self.state()
        for name, df in tables.items():
            part = f"parts/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{part}")
            state = {**state, name: [*state.get(name, []), part]}
        self._commit(number + 1, state)
        return number + 1

    def _commit(self, number: int, state: dict[str, list[str]]) -> None:
        draft, final = self._path("drafts", uuid.uuid4().hex), self._path("manifests", f"{number:09}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"state {number} of {self.folder} was published by another append")

    def read(self, name: str) -> DataFrame:
        """All published rows of a table."""
        parts = self.state().get(name)
        if not parts:
            raise ValueError(f"{self.folder} has no table {name}")
        return self.spark.read.parquet(*(f"{self.folder}/{p}" for p in parts))
