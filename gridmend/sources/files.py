"""File sources and sinks with contracts: typed CSV, text formats, manifests, safe destinations."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar, text

#: Bytes of a file that a task holds at once.
CHUNK = 1 << 20


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] = ()) -> DataFrame:
    """CSV (gzip or plain) with a header and a declared schema; malformed rows fail. Only ``columns`` are parsed."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def read_lenient(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV whose rows may have fewer or more fields: missing ones are null, further ones are dropped."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, value) of headerless files of one number a line; blank lines don't count."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("place", "value"))
    return lines.withColumn("value", F.trim("value").cast("double"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, class, name, properties) of element lines; a property given again is a list of all its values."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), text.without_comment(F.col("value")).alias("line"))
    found = lines.select("path", text.element(F.col("line")).alias("e"), text.tokens(F.col("line")).alias("t")).where("e is not null")
    keys = F.array_distinct(F.transform("t", lambda p: p["key"]))
    props = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter("t", lambda p: p["key"] == k), lambda p: p["value"])))
    return found.select("path", "e.class", "e.name", props.alias("properties"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(bus, lon, lat) of lines with a name and two numbers; pairs whose first number can't be a longitude are turned."""
    parts = F.split(F.trim(F.regexp_replace("value", ",", " ")), r"\s+")
    x = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 3)
    x = x.select(F.lower(F.col("p")[0]).alias("bus"), scalar.numeric_or_null(F.col("p")[1]).alias("a"), scalar.numeric_or_null(F.col("p")[2]).alias("b")).where("a is not null and b is not null")
    turned = (F.col("a") > 0) & (F.col("b") < 0)
    return x.select("bus", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("lon"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("lat"))


def read_script_rows(spark: SparkSession, path: str, name: str, pattern: str, fields: Sequence[str]) -> DataFrame:
    """Rows of the one array literal that a script assigns to ``name``; more than one literal, or text in it that no
    row accounts for, raises."""
    whole = spark.read.text(path, wholetext=True).select(text.array_literals(F.col("value"), name).alias("found"))
    body = F.when(F.size("found") == 1, F.col("found")[0]).otherwise(F.raise_error(F.lit(f"{name} isn't given exactly once")).cast("string"))
    rest = F.regexp_replace(F.regexp_replace(F.col("body"), pattern, ""), r"[\s,]", "")
    checked = whole.select(body.alias("body")).select(F.when(rest == "", F.col("body")).otherwise(F.raise_error(F.concat(F.lit("not understood: "), rest)).cast("string")).alias("body"))
    groups = [F.regexp_extract_all("body", F.lit(pattern), F.lit(i + 1)).alias(f) for i, f in enumerate(fields)]
    return checked.select(F.explode(F.arrays_zip(*groups)).alias("r")).select(*(F.col("r")[f].alias(f) for f in fields))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_features(spark: SparkSession, paths: Sequence[str], properties: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON pages: their properties and, for polygons, the rings as arrays of points. ``lines``: a page is
    a line of its file and not the whole of it."""
    schema = f"features array<struct<properties struct<{properties}>, geometry struct<type string, coordinates array<array<array<double>>>>>>"
    page = spark.read.schema(schema).option("multiLine", not lines).json(list(paths))
    return page.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("rings"))


def point_in_ring(x, y, ring):
    """Whether a point lies in a ring, by how many edges a ray from it crosses."""
    n = F.size(ring)
    pairs = F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.element_at(ring, F.pmod(i + 1, n).cast("int") + 1).alias("q")))

    def crosses(e):
        (x1, y1), (x2, y2) = ((e[k][0], e[k][1]) for k in ("p", "q"))
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)

    return F.size(F.filter(pairs, crosses)) % 2 == 1


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, which a plain one has from the cluster's settings."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark tells, and the path there; ArrowException or ValueError where Arrow doesn't know it. A plain
    path is none that Spark tells: which file system it is on is known to the driver alone, see qualified()."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        raise ValueError(f"{path} has no scheme")
    return pafs.FileSystem.from_uri(f"file:///{quote(rest.lstrip('/'))}" if scheme == "file" else quote(path, safe="/:@"))


def _known(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


def _sha256(path: str) -> str:
    fs, at = opened(path)
    found = hashlib.sha256()
    with fs.open_input_stream(at) as f:
        while chunk := f.read(CHUNK):
            found.update(chunk)
    return found.hexdigest()


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files below a path. Files go through a task in chunks, so they may be of any size; where Arrow
    doesn't know the file system, Spark reads them whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first = files.select("path").head()
    if first is None or not _known(first.path):
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_sha256(p) for p in b.column(0).to_pylist()], pa.string())], names=[*b.schema.names, "sha256"])

    return files.select("path", "length").mapInArrow(run, "path string, length long, sha256 string")


def joined(spark: SparkSession, parts: dict[str, list[str]]) -> None:
    """Writes a file for each of ``parts`` (path: the files that make it up, in order). A task copies one in chunks, under another name
    until it is whole."""
    rows = spark.createDataFrame([(qualified(spark, k), [qualified(spark, p) for p in x]) for k, x in parts.items()], "path string, parts array<string>").repartition(max(1, len(parts)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, at = opened(row["path"])
                folder, _, name = at.rpartition("/")
                fs.create_dir(folder, recursive=True)
                half = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(half) as out:
                    for part in row["parts"]:
                        own, source = opened(part)
                        with own.open_input_stream(source) as f:
                            while chunk := f.read(CHUNK):
                                out.write(chunk)
                fs.move(half, at)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    rows.mapInArrow(run, "path string").collect()  # the paths


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of all files below a path; names are relative to it."""
    files = contents(spark, path)
    folder = re.sub(r"^[a-z0-9]+:/+", "/", path).rstrip("/") + "/"
    at = F.instr("path", folder)
    name = F.when(at > 0, F.substring("path", at + len(folder), F.length("path"))).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.select(name.alias("name"), F.col("length").alias("bytes"), "sha256")


def manifest_violations(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, rule): files that are missing, differ from the manifest (name, sha256), or aren't in it; and names that
    would leave the folder."""
    met = digests(spark, path).join(manifest.select("name", F.col("sha256").alias("want")), "name", "full_outer")
    rule = F.when(F.col("name").contains("..") | F.col("name").startswith("/"), "name leaves the folder").when(F.col("sha256").isNull(), "file is missing").when(F.col("want").isNull(), "file isn't listed").when(F.col("want") != F.col("sha256"), "content differs")
    return met.select("name", rule.alias("rule")).where("rule is not null")


def write_new(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Writes where nothing is yet; a destination with anything in it fails."""
    df.write.mode("errorifexists").options(**options).format(kind).save(path)


def write_geojson(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """Features as JSON lines, a point for each row."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.mode("errorifexists").text(path)


def write_provenance(spark: SparkSession, path: str, arguments: dict, inputs: DataFrame) -> None:
    """One row: arguments, the inputs' digests in the order of their names, and the engine's version."""
    listed = inputs.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "sha256")))).alias("inputs"))
    row = listed.select(F.lit(json.dumps(arguments, sort_keys=True, separators=(",", ":"))).alias("arguments"), "inputs", F.lit(spark.version).alias("engine"))
    row.coalesce(1).write.mode("errorifexists").json(path)


def load_config(path: str, spark: SparkSession | None = None) -> dict:
    """A YAML mapping; where PyYAML isn't there, a JSON one. With ``spark``, from any path that it reads."""
    if spark is not None:
        (row,) = spark.read.text(path, wholetext=True).collect()  # one file
        body = row.value
    else:
        with open(path, encoding="utf-8") as f:
            body = f.read()
    try:
        import yaml

        found = yaml.safe_load(body)
    except ImportError:
        found = json.loads(body)
    if not isinstance(found, dict):
        raise ValueError(f"{path} isn't a mapping")
    return found


def array_table(spark: SparkSession, array, ids: Sequence[str]) -> DataFrame:
    """(profile_id, profile) of a two-dimensional array, read in slices so that a mapped file is never whole in memory."""
    import pandas as pd

    parts = [spark.createDataFrame(pd.DataFrame({"profile_id": ids[i : i + 64], "profile": [row.tolist() for row in array[i : i + 64]]}), "profile_id string, profile array<float>") for i in range(0, len(ids), 64)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
