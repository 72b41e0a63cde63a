"""Array files (.npy, .npz) and zipped shapefiles, read on executors."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, row, values): a row for each row of each array of .npy and .npz files; name is empty for .npy.

    Arrays of one dimension are a row. Object arrays are refused. A file is one record, of 2 GB at most.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf.path, pdf.content, strict=True):
                found = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                arrays = {"": found} if isinstance(found, np.ndarray) else dict(found)
                for name, a in arrays.items():
                    a = np.atleast_2d(a).reshape(-1, a.shape[-1]) if a.ndim else a.reshape(1, 1)
                    for start in range(0, len(a), 1000):
                        part = a[start : start + 1000].astype(float)
                        yield pd.DataFrame({"path": file, "name": name, "row": np.arange(start, start + len(part)), "values": list(part)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, name string, row long, values array<double>")


def polygons(shp: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(record number, rings) of the polygons of a .shp part; null shapes have no rings, other kinds fail."""
    at = 100
    while at < len(shp):
        number, words = struct.unpack(">ii", shp[at : at + 8])
        body = shp[at + 8 : at + 8 + 2 * words]
        (kind,) = struct.unpack("<i", body[:4])
        if kind not in (0, 5):
            raise ValueError(f"record {number} has shapes of kind {kind}; polygons are read")
        rings = []
        if kind == 5:
            n, points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{n}i", body[44 : 44 + 4 * n]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * n : 44 + 4 * n + 16 * points])
            rings = [[(xy[2 * k], xy[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        yield number, rings
        at += 8 + 2 * words


def attributes(dbf: bytes) -> Iterator[dict[str, str]]:
    """The records of a .dbf part as trimmed texts; deleted ones are left out."""
    n, head, size = struct.unpack("<IHH", dbf[4:12])
    fields = [(dbf[k : k + 11].split(b"\0")[0].decode("latin-1"), dbf[k + 16]) for k in range(32, head - 1, 32)]
    for i in range(n):
        row, at, out = dbf[head + i * size : head + (i + 1) * size], 1, {}
        for name, width in fields:
            out[name] = row[at : at + width].decode("latin-1").strip()
            at += width
        if row[:1] != b"*":
            yield out


def read_shapes(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(path, record, columns as texts, rings) of the polygons in zipped shapefiles."""
    columns = list(columns)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    part = {n.rsplit(".", 1)[-1].lower(): n for n in z.namelist()}
                    shapes, about = list(polygons(z.read(part["shp"]))), list(attributes(z.read(part["dbf"])))
                if len(shapes) != len(about):
                    raise ValueError(f"{file}: {len(shapes)} shapes, {len(about)} records")
                rows = [(file, k, *(a[c] for c in columns), [[list(p) for p in ring] for ring in rings]) for (k, rings), a in zip(shapes, about, strict=True)]
                yield pd.DataFrame(rows, columns=["path", "record", *columns, "rings"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, record long, " + ", ".join(f"`{c}` string" for c in columns) + ", rings array<array<array<double>>>")


def shapefile(rows: Sequence[tuple[dict[str, str], list[list[tuple[float, float]]]]]) -> bytes:
    """A zipped shapefile of polygons with text attributes, for exports and tests."""
    records = b""
    for i, (_, rings) in enumerate(rows, 1):
        xy = [p for ring in rings for p in ring]
        starts = np.cumsum([0, *(len(r) for r in rings)])[:-1].tolist()
        box = (min(x for x, _ in xy), min(y for _, y in xy), max(x for x, _ in xy), max(y for _, y in xy))
        body = struct.pack("<i4dii", 5, *box, len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{2 * len(xy)}d", *(c for p in xy for c in p))
        records += struct.pack(">ii", i, len(body) // 2) + body
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    names = list(rows[0][0])
    widths = [max(1, *(len(a[n].encode("latin-1")) for a, _ in rows)) for n in names]
    dbf = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(widths))
    dbf += b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for n, w in zip(names, widths, strict=True)) + b"\r"
    dbf += b"".join(b" " + b"".join(a[n].encode("latin-1").ljust(w) for n, w in zip(names, widths, strict=True)) for a, _ in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("shape.shp", head + records)
        z.writestr("shape.dbf", dbf)
    return out.getvalue()
