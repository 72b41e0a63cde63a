"""The data source for model files: records over lines and splits, and the tables that come of them."""

import io
import random

import pyarrow as pa
import pytest

from gridmend.operators import elements
from gridmend.sources import model_files as mf

TEXT = """! head
Clear
~ lost=1
New Circuit.c basekv=69 // note
New Line.a bus1=x.1.2 bus2 = y length=3.5
~ units=km linecode="two words" ! with a comment

  more Switch=Y
New object=Transformer.T windings=2 wdg=1 bus=x kv=69
// between
~ wdg=2 bus=y kv=12.5 kvas=(100 200)
set mode=daily
New Load.l bus1=y.3 kW=5 Daily='sh "1"'"""


def whole(text):
    out = []
    for at, line in mf.lines(pa.BufferReader(text.encode()), 0):
        line = mf.without_comment(line)
        more = mf._CONTINUES.fullmatch(line)
        if more and line.strip():
            if out:
                out[-1][1].append(more[1].strip())
        elif line.strip():
            out.append((at, [line.strip()]))
    return [(at, " ".join(parts)) for at, parts in out]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_each_record_is_read_once_wherever_cuts_fall(monkeypatch, chunk):
    monkeypatch.setattr(mf, "CHUNK", chunk)
    raw = TEXT.encode()
    want = whole(TEXT)
    assert len(want) == 6
    for size in (1, 5, 64, len(raw)):
        got = [r for a in range(0, len(raw), size) for r in mf.records(pa.BufferReader(raw), a, min(len(raw), a + size))]
        assert got == want, size


def test_random_files_survive_random_cuts():
    rng = random.Random(2)
    for _ in range(60):
        text = "\n".join(rng.choice(["New Line.a x=1", "~ y=2", "", "! c", "more z=3", "  ~ w=4 // d", "Set a=b"]) for _ in range(rng.randint(0, 25))) + rng.choice(["", "\n", "\r\n"])
        raw = text.encode()
        cuts = sorted({0, len(raw), *(rng.randint(0, len(raw)) for _ in range(4))})
        got = [r for a, b in zip(cuts, cuts[1:], strict=False) for r in mf.records(pa.BufferReader(raw), a, b)]
        assert got == whole(text), (text, cuts)


def test_records_are_parsed():
    assert mf.parsed("New Line.A bus1=x.1 B2 = [1 2]  'free' Q=\"a b\"") == ("new", "line", "A", [("bus1", "x.1"), ("b2", "1 2"), ("", "free"), ("q", "a b")])
    assert mf.parsed("Clear") == ("clear", None, None, []) and mf.without_comment("a '!' b ! c") == "a '!' b "


@pytest.mark.parametrize("split", [20, 1000])
def test_tables_of_elements(spark, tmp_path, split):
    (tmp_path / "feeder").mkdir()
    (tmp_path / "feeder" / "a.dss").write_text(TEXT)
    (tmp_path / "shapes.dss").write_text("New LoadShape.s npts=2 sinterval=1800\n~ mult=[0.5, 1]\nNew LoadShape.f pmult=(file=x.csv)\n")
    spark.dataSource.register(mf.ModelFiles)
    x = spark.read.format("model_files").option("split_bytes", split).load(f"file://{tmp_path}")
    assert x.count() == 8 and x.rdd.getNumPartitions() > (1 if split > 100 else 15)
    (line,) = elements.line_elements(x).collect()
    assert (line.name, line.bus1, line.bus2, line.length, line.units, line.linecode, line.is_switch, line.is_closed) == ("a", "x", "y", 3.5, "km", "two words", True, True)
    assert [tuple(r) for r in elements.switch_elements(x).collect()] == [("a", "x", "y", "closed")]
    got = {r.winding: (r.bus, r.kv, r.kva, r.windings) for r in elements.transformer_windings(x).collect()}
    assert got == {1: ("x", 69.0, 100.0, 2), 2: ("y", 12.5, 200.0, 2)}
    (load,) = elements.load_elements(x).collect()
    assert (load.bus, load.phases, load.kw, load.kvar, load.profile_id) == ("y", 1, 5.0, None, 'sh "1"')
    shapes = {r.name: (r.npts, r.interval_h, r["values"], r.p_file) for r in elements.profile_elements(x).collect()}
    assert shapes == {"s": (2, 0.5, [0.5, 1.0], None), "f": (None, None, None, "x.csv")}
    only = spark.read.format("model_files").option("classes", "Load, line").load(f"file://{tmp_path}")
    assert only.count() == 2


def test_small_splits_share_tasks_and_read_little(tmp_path):
    """Many splits are few tasks, which read in proportion to the bytes of the files."""
    text = "".join(f"New Load.L{i} kW={i}\n~ kV=1\n" for i in range(40_000))
    (tmp_path / "a.dss").write_text(text)
    (tmp_path / "b.dss").write_text("New Load.Last kW=1\n")
    reader = mf._Reader({"path": f"file://{tmp_path}", "split_bytes": "256"})
    tasks = reader.partitions()
    splits = [x for t in tasks for x in t.parts]
    assert len(splits) > 4_000 and len(tasks) <= mf.LEAST_TASKS + 1
    assert sum(stop - start for _, start, stop in splits) == len(text) + 19
    assert [len(b) for t in tasks for b in reader.read(t)] and sum(b.num_rows for t in tasks for b in reader.read(t)) == 40_001

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

    f = Counted(text.encode())
    assert sum(1 for a in range(0, 65_536, 256) for _ in mf.records(f, a, a + 256)) > 2_000
    assert Counted.taken < 8 * 65_536
