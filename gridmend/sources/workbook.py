"""Sheets of workbooks (.xlsx): a zip archive of XML parts, read on executors with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts; cells that aren't there are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = [s.get(_LINK) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet") if s.get("name", "").strip() == sheet]
        if len(found) != 1:
            raise ValueError(f"the workbook has {len(found)} sheets named {sheet}")
        part = links[found[0]].lstrip("/")
        for row in ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}")).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_MAIN}c"):
                at = 0
                for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(letter) - 64
                value = c.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def read_sheet(spark: SparkSession, path: str, sheet: str, columns: Sequence[str]) -> DataFrame:
    """(path, row, columns as texts) of a sheet of each workbook below ``path``. Headers are trimmed; all ``columns`` must
    be there, others are left out; rows without any value don't count."""
    columns = list(columns)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf.path, pdf.content, strict=True):
                rows = sheet_rows(bytes(content), sheet)
                header = [(h or "").strip() for h in next(rows, [])]
                lost = [c for c in columns if c not in header]
                if lost:
                    raise ValueError(f"{file}: no columns {lost}")
                at = [header.index(c) for c in columns]
                out = [(file, i, *(r[k] if k < len(r) else None for k in at)) for i, r in enumerate(rows) if any(x not in (None, "") for x in r)]
                yield pd.DataFrame(out, columns=["path", "row", *columns])

    books = spark.read.format("binaryFile").load(path).select("path", "content")
    return books.mapInPandas(read, "path string, row long, " + ", ".join(f"`{c}` string" for c in columns))


def workbook(sheets: dict[str, list[Sequence[object]]]) -> bytes:
    """A workbook with texts and numbers in its sheets, for exports and tests."""

    def letters(i: int) -> str:
        return letters(i // 26 - 1) + chr(65 + i % 26) if i >= 26 else chr(65 + i)

    def cell(at: str, x: object) -> str:
        if x is None:
            return ""
        if isinstance(x, (int, float)):
            return f'<c r="{at}"><v>{x!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    main, rel = _MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{k}">' + "".join(cell(f"{letters(j)}{k}", x) for j, x in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
