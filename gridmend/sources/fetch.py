"""Listing, pinned fetching and bundles of files, over any file system that Hadoop knows.

``s3a``, ``http(s)``, ``hdfs`` and local paths are the same here: what can be reached is a matter of the cluster's
settings. Whatever a manifest lists is checked by its digest before it counts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import digests


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_objects(spark: SparkSession, prefix: str) -> DataFrame:
    """(path, bytes) of all files below a prefix; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix).select("path", F.col("length").alias("bytes"))


def list_prefixes(spark: SparkSession, prefix: str) -> list[str]:
    """The names of the folders right below a prefix, in order."""
    fs, p = _fs(spark, prefix)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_lines) of text files."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("n_lines"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A new file from the driver, for contents that a driver makes; an existing one fails."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def safe_name(name: str) -> str:
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"{name!r} would leave its folder")
    return name


def fetch_pinned(spark: SparkSession, manifest: Sequence[dict], folder: str, offline: bool = False) -> DataFrame:
    """Files of a manifest (name, url, sha256) in ``folder``, copied there unless they are there already, with receipts
    (name, url, sha256, bytes, status).

    ``offline``: nothing is copied, and what is missing fails. A file whose digest isn't the pinned one fails, and a
    copy that differs is deleted. The manifest is a driver's list; contents go from file system to file system.
    """
    conf, copied = spark._jsc.hadoopConfiguration(), set()
    for item in manifest:
        fs, p = _fs(spark, f"{folder}/{safe_name(item['name'])}")
        if not fs.exists(p):
            if offline:
                raise FileNotFoundError(f"{item['name']} isn't there, and nothing is fetched offline")
            source, at = _fs(spark, item["url"])
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source, at, fs, p, False, conf)
            copied.add(item["name"])
    found = {r.name: r for r in digests(spark, folder).collect()}  # as many as the manifest has, and what else is there
    wrong = [i["name"] for i in manifest if found[i["name"]].sha256 != i["sha256"]]
    for name in copied & set(wrong):
        fs, p = _fs(spark, f"{folder}/{name}")
        fs.delete(p, False)
    if wrong:
        raise ValueError(f"digests differ: {sorted(wrong)}")
    rows = [(i["name"], i["url"], i["sha256"], found[i["name"]].bytes, "fetched" if i["name"] in copied else "cached") for i in manifest]
    return spark.createDataFrame(rows, "name string, url string, sha256 string, bytes long, status string")


def export_bundle(spark: SparkSession, paths: dict[str, str], folder: str) -> DataFrame:
    """Copies of files (name: path) in a new folder, with a manifest.json of their digests; returns (name, bytes, sha256)."""
    fs, root = _fs(spark, folder)
    if fs.exists(root):
        raise FileExistsError(folder)
    for name, path in paths.items():
        source, at = _fs(spark, path)
        target, to = _fs(spark, f"{folder}/{safe_name(name)}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source, at, target, to, False, spark._jsc.hadoopConfiguration())
    made = digests(spark, folder).orderBy("name")
    listed = [{"name": r.name, "bytes": r.bytes, "sha256": r.sha256} for r in made.collect()]
    write_bytes(spark, f"{folder}/manifest.json", json.dumps(listed, sort_keys=True, separators=(",", ":")).encode())
    return spark.createDataFrame([(x["name"], x["bytes"], x["sha256"]) for x in listed], "name string, bytes long, sha256 string")
