"""A data source for line-oriented model files: commands with properties, continued over lines.

    spark.dataSource.register(ModelFiles)
    spark.read.format("model_files").option("split_bytes", 1 << 25).load(folder)

Files are read in splits. A record belongs to the split in which its first line begins; its continuation lines (``~`` or
``more``) are read from wherever they lie, and a split skips those it begins with. So a large file is read by many tasks, and
a record that a cut falls into is read once and whole. Small splits and small files are packed into tasks of TASK_BYTES, and what is
read at once is no larger than a split, so work grows with the bytes of the files however finely they are cut. Folders are looked
through; Arrow opens the files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, at long, verb string, kind string, name string, properties array<struct<key:string,value:string>>"
SPLIT_BYTES, CHUNK, BATCH = 32 << 20, 1 << 20, 2_000
#: Bytes of splits that a task takes, and how many tasks there should be before it takes so many.
TASK_BYTES, LEAST_TASKS = 8 << 20, 32
_CONTINUES = re.compile(r"\s*(?:~|more\b)(.*)", re.IGNORECASE | re.DOTALL)
_VALUE = r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|\"[^\"]*\"|'[^']*'|[^\s,=]+"
_TOKEN = re.compile(rf"(?:([^\s=,]+)\s*=\s*)?({_VALUE})")
_ARROW = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("verb", pa.string()), ("kind", pa.string()), ("name", pa.string()),
    ("properties", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
])


def without_comment(line: str) -> str:
    """``line`` up to ! or // outside quotes."""
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "!" or line.startswith("//", i):
            return line[:i]
    return line


def parsed(text: str) -> tuple[str, str | None, str | None, list[tuple[str, str]]]:
    """(verb, kind, name, properties) of a record. Keys are in lower case and may repeat; a value without a key has an empty one."""
    verb, _, rest = text.strip().partition(" ")
    found = [((m[1] or "").lower(), m[2][1:-1].strip() if m[2][0] in "[({\"'" else m[2]) for m in _TOKEN.finditer(rest)]
    kind = name = None
    if found and found[0][0] in ("", "object") and "." in found[0][1]:
        kind, _, name = found.pop(0)[1].partition(".")
        kind = kind.lower()
    return verb.lower(), kind, name, found


def lines(f: pa.NativeFile, at: int, chunk: int = CHUNK) -> Iterator[tuple[int, str]]:
    """Each line from byte ``at`` on, with its place; ``chunk`` bytes are read first, then twice as many each time, up to CHUNK."""
    f.seek(at)
    rest = b""
    while True:
        more, chunk = f.read(chunk), min(CHUNK, 2 * chunk)
        *whole, rest = (rest + more).split(b"\n")
        for line in whole:
            yield at, line.decode("utf-8", "replace").rstrip("\r")
            at += len(line) + 1
        if not more:
            if rest:
                yield at, rest.decode("utf-8", "replace").rstrip("\r")
            return


def records(f: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, str]]:
    """The records that begin in [start, stop), as one line each."""
    now: tuple[int, list[str]] | None = None
    found = lines(f, max(0, start - 1), min(CHUNK, stop - start + 1))
    if start:
        next(found, None)  # up to the first line that begins at ``start`` or later
    for at, line in found:
        line = without_comment(line)
        if not line.strip():
            continue
        more = _CONTINUES.fullmatch(line)
        if more:
            if now:
                now[1].append(more[1].strip())
            continue
        if now:
            yield now[0], " ".join(now[1])
        if at >= stop:
            return
        now = at, [line.strip()]
    if now:
        yield now[0], " ".join(now[1])


@dataclass
class Split(InputPartition):
    """``parts``: (path, start, stop) of what a task reads, one after the other."""

    parts: list[tuple[str, int, int]]


def packed(splits: list[tuple[str, int, int]]) -> list[Split]:
    """``splits`` in their order, dealt into tasks."""
    most = min(TASK_BYTES, -(-sum(stop - start for _, start, stop in splits) // LEAST_TASKS))
    tasks: list[list] = []
    room = 0
    for path, start, stop in splits:
        if not tasks or stop - start > room:
            tasks.append([])
            room = most
        tasks[-1].append((path, start, stop))
        room -= stop - start
    return [Split(parts) for parts in tasks]


class ModelFiles(DataSource):
    """Rows of SCHEMA. Options: path, split_bytes, and classes, a comma-separated list of the kinds that are wanted."""

    @classmethod
    def name(cls) -> str:
        return "model_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.size = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.kinds = {k.strip().lower() for k in options.get("classes", "").split(",") if k.strip()}

    def _where(self) -> tuple[pafs.FileSystem, str]:
        uri = self.uri if "://" in self.uri or not self.uri.startswith("file:") else "file://" + self.uri[5:]
        return pafs.FileSystem.from_uri(uri)

    def partitions(self) -> list[Split]:
        fs, root = self._where()
        info = fs.get_file_info(root)
        files = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and i.base_name[0] not in "._"]
        return packed([(i.path, a, min(i.size, a + self.size)) for i in sorted(files, key=lambda i: i.path) for a in range(0, i.size, self.size)])

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        fs, _ = self._where()
        rows: list[tuple] = []
        for path, splits in groupby(partition.parts, key=lambda x: x[0]):
            with fs.open_input_file(path) as f:
                for _, start, stop in splits:
                    for at, text in records(f, start, stop):
                        verb, kind, name, found = parsed(text)
                        if not self.kinds or kind in self.kinds:
                            rows.append((path, at, verb, kind, name, [{"key": k, "value": v} for k, v in found]))
                        if len(rows) == BATCH:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
