import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmend.sources import files


def test_csv_round_trip_and_refusal(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    path = str(tmp_path / "out")
    files.write_new(df, path, "csv", header="true", compression="gzip")
    assert sorted(map(tuple, files.read_csv(spark, path, df.schema).collect())) == [(1, "a"), (2, None)]
    assert files.read_csv(spark, path, df.schema, ["id"]).columns == ["id"]
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_new(df, path, "csv")


def test_numbers_and_coordinates(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1.5\n\n 2\n")
    assert [(r.place, r.value) for r in files.read_numbers(spark, str(tmp_path / "p.csv")).collect()] == [(0, 1.5), (1, 2.0)]
    (tmp_path / "b.txt").write_text("N1 -95.1 29.7\nN2, 29.8, -95.2\nbad line\nN3 x y\n")
    assert sorted(map(tuple, files.read_coordinates(spark, str(tmp_path / "b.txt")).collect())) == [("n1", -95.1, 29.7), ("n2", -95.2, 29.8)]


def test_elements(spark, tmp_path):
    (tmp_path / "a.dss").write_text('! nothing\nNew Line.L1 bus1=a bus2=b.1 length=2 ! x=1\nnew "Load.D" kw=3 kw=4\nset x=1\n')
    got = {r.name: (r["class"], r.properties) for r in files.read_elements(spark, str(tmp_path / "a.dss")).collect()}
    assert got == {"l1": ("line", {"bus1": ["a"], "bus2": ["b.1"], "length": ["2"]}), "d": ("load", {"kw": ["3", "4"]})}


def test_script_rows(spark, tmp_path):
    (tmp_path / "ok.js").write_text('var rows=[{s:"TX",v:1.5},{s:"LA",v:2}];')
    pattern = r'\{s:"(\w+)",v:([\d.]+)\}'
    assert [tuple(r) for r in files.read_script_rows(spark, str(tmp_path / "ok.js"), "rows", pattern, ["state", "gw"]).collect()] == [("TX", "1.5"), ("LA", "2")]
    (tmp_path / "bad.js").write_text('rows=[{s:"TX",v:1.5},{s:"LA"}]')
    with pytest.raises(Exception, match="not understood"):
        files.read_script_rows(spark, str(tmp_path / "bad.js"), "rows", pattern, ["state", "gw"]).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"x")
    (tmp_path / "d" / "b.bin").write_bytes(b"y")
    sums = {r.name: r.sha256 for r in files.digests(spark, str(tmp_path / "d")).collect()}
    manifest = spark.createDataFrame([("a.bin", sums["a.bin"]), ("c.bin", "0"), ("../e", "0")], "name string, sha256 string")
    got = {(r.name, r.rule) for r in files.manifest_violations(spark, str(tmp_path / "d"), manifest).collect()}
    assert got == {("b.bin", "file isn't listed"), ("c.bin", "file is missing"), ("../e", "name leaves the folder")}


def test_features_and_points_in_rings(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"properties": {"id": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    f = files.read_features(spark, [str(tmp_path / "f.json")], "id string")
    inside = f.select(*(files.point_in_ring(F.lit(x), F.lit(y), F.col("rings")[0]).alias(k) for k, x, y in (("a", 1.0, 1.0), ("b", 5.0, 1.0)))).first()
    assert (inside.a, inside.b) == (True, False)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("n1", -95.0, 29.0)], "id string, lon double, lat double")
    files.write_geojson(df, str(tmp_path / "g"))
    assert json.loads(spark.read.text(str(tmp_path / "g")).first()[0])["properties"] == {"id": "n1"}
    files.write_provenance(spark, str(tmp_path / "p"), {"b": 1, "a": 2}, spark.createDataFrame([("x", "1")], "name string, sha256 string"))
    assert spark.read.json(str(tmp_path / "p")).first().arguments == '{"a":2,"b":1}'


def test_config_and_arrays(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert files.load_config(str(tmp_path / "c.json")) == {"a": 1}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path / "l.json"))
    got = files.array_table(spark, np.arange(6, dtype=np.float32).reshape(2, 3), ["p", "q"]).collect()
    assert {r.profile_id: r.profile for r in got} == {"p": [0.0, 1.0, 2.0], "q": [3.0, 4.0, 5.0]}


def test_parts_are_joined_in_order_and_digests_stream(spark, tmp_path):
    """Files of many ranges become one, and no row holds the contents of a file."""
    folder = tmp_path / "ranges" / "role=4-NOT SPECIFIED"
    folder.mkdir(parents=True)
    parts = [folder / f"part-{i}.txt" for i in (0, 1, 2)]
    for i, p in enumerate(parts):
        p.write_bytes(bytes([65 + i]) * (files.CHUNK + i))
    whole = b"".join(p.read_bytes() for p in parts)
    target = tmp_path / "runs" / "role=4-NOT SPECIFIED" / "part-00000.txt"
    files.joined(spark, {f"file://{target}": [f"file:{p}" for p in parts]})
    assert target.read_bytes() == whole and [p.name for p in target.parent.iterdir() if not p.name.endswith(".crc")] == [target.name]
    found = files.digests(spark, str(tmp_path / "runs"))
    assert [tuple(r) for r in found.collect()] == [("role=4-NOT SPECIFIED/part-00000.txt", len(whole), hashlib.sha256(whole).hexdigest())]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_parts_are_joined_at_plain_paths(spark, tmp_path):
    """A path without a scheme names the same file as with one, whatever its letters."""
    (tmp_path / "a b").write_bytes(b"x")
    (tmp_path / "c=1%20").write_bytes(b"y")
    target = tmp_path / "runs" / "role=4-NOT SPECIFIED %41" / "part-00000.txt"
    files.joined(spark, {str(target): [str(tmp_path / "a b"), str(tmp_path / "c=1%20")]})
    assert target.read_bytes() == b"xy" and [p.name for p in (tmp_path / "runs").iterdir()] == [target.parent.name]
    with pytest.raises(ValueError, match="no scheme"):
        files.opened(str(target))
