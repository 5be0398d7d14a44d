"""Workbooks of all formats as a Spark data source: one input partition per file, sheet and range of rows.

    spark.dataSource.register(WorkbookSource)          # or read_workbooks(), which does so
    spark.read.format("workbooks").option("sheet", "*").load("/books/*.xls*")

gives source_id (the file's path), sheet, row_idx (from the sheet's first used row, gaps count), cells. A large sheet is read
by several tasks: a sheet's part is a compressed stream, which each task unpacks from its start, but only the tags of the
rows before its range are looked at (they number the rows), and only its own rows become cells. .xls sheets, of 65,536
rows at most, are read by one task each. A filter on row_idx from above (row_idx < n) ends a task's reading, so that
looking for headers reads the first rows of each sheet alone.

The files are opened by the driver (which lists sheets) and by the tasks: local or shared paths and what pyarrow.fs can
open by its address. For a store that only Spark reads, xlsx.read_sheets takes whole files through binaryFile.
"""

from __future__ import annotations

import glob
import io
import os
import re
import sys
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import inf
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual

from ledgerloom.plans.model import ReconciliationError
from ledgerloom.sources import biff, xlsx

#: Unpacked bytes of a sheet that one task turns into cells.
RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
BATCH = 2_000
SCHEMA = "source_id string, sheet string, row_idx bigint, cells array<string>"
_ARROW = pa.schema([("source_id", pa.string()), ("sheet", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])
_ROW = re.compile(rb"<(?:[\w.-]+:)?row(?=[\s/>])[^>]*>")
_NUMBER = re.compile(rb"""\sr\s*=\s*["'](\d+)["']""")
_ROOT = re.compile(rb"<((?:[\w.-]+:)?worksheet)(?=[\s>])[^>]*>")


def open_file(path: str) -> io.BufferedIOBase:
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(path.removeprefix("file:"), "rb")  # noqa: SIM115  (the caller closes it)


def list_files(path: str) -> list[str]:
    """A file, the files of a folder, or those of a local glob."""
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        found = system.get_file_info(at)
        if found.type == fs.FileType.File:
            return [path]
        prefix = path.split("://")[0]
        return sorted(f"{prefix}://{'/' if prefix == 'file' else ''}{x.path.lstrip('/')}" for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File)
    path = path.removeprefix("file:")
    return sorted(x for x in glob.glob(f"{path}/*" if os.path.isdir(path) else path) if os.path.isfile(x))


@dataclass
class Range(InputPartition):
    path: str
    kind: str
    sheet: str
    part: str
    lo: int
    hi: float
    first: int | None


# ---- the formats' sheets ------------------------------------------------------------------------------------------


def _xlsb_parts(book: zipfile.ZipFile) -> dict[str, str]:
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.bin.rels"))}
    with book.open("xl/workbook.bin") as f:
        return {k: v.lstrip("/") if v.startswith("/") else f"xl/{v}" for k, v in biff.xlsb_sheets(f, targets).items()}


def _first_row(book: zipfile.ZipFile, kind: str, part: str) -> int | None:
    """The number of a sheet's first row, from 0."""
    with book.open(part) as f:
        return next((n for n, _ in (biff.xlsb_rows if kind == "xlsb" else xml_rows)(f, [], sys.maxsize)), None)


def ranges(path: str, sheet: str | None, size: int = RANGE_BYTES) -> list[Range]:
    """A file's ranges: of all sheets (sheet "*"), the named one, or the first."""
    with open_file(path) as f:
        magic = f.read(8)
        f.seek(0)
        if magic == biff.OLE_MAGIC:
            names = list(biff.xls_globals(biff.ole_stream(f.read()))[0])
            return [Range(path, "xls", n, "", 0, inf, None) for n in (names if sheet == "*" else [xlsx.resolve_sheet(names, sheet)])]
        try:
            book = zipfile.ZipFile(f)
        except zipfile.BadZipFile as e:
            raise ReconciliationError("NOT_A_WORKBOOK", path) from e
        with book:
            kind = "xlsb" if "xl/workbook.bin" in book.namelist() else "xlsx"
            parts = _xlsb_parts(book) if kind == "xlsb" else xlsx.sheet_paths(book)
            out = []
            for name in parts if sheet == "*" else [xlsx.resolve_sheet(parts, sheet)]:
                total, first = book.getinfo(parts[name]).file_size, _first_row(book, kind, parts[name])
                cuts = list(range(0, total, size)) or [0]
                out += [Range(path, kind, name, parts[name], lo, hi, first) for lo, hi in zip(cuts, [*cuts[1:], inf], strict=True)]
            return out


# ---- rows of a range ----------------------------------------------------------------------------------------------


def xml_rows(f: io.BufferedIOBase, strings: Sequence[str], lo: int = 0, hi: float = inf) -> Iterator[tuple[int, list[str] | None]]:
    """(number from 0, cells) of the rows whose tag begins in [lo, hi) of a sheet's part; rows before lo come without cells."""
    data, base, at, number, root = b"", 0, 0, -1, b""

    def more() -> bool:
        """Read on; what lies before `at` is done with."""
        nonlocal data, base, at
        chunk = f.read(CHUNK)
        data, base, at = data[at:] + chunk, base + at, 0
        return bool(chunk)

    while not root:
        if m := _ROOT.search(data):
            root, close, at = m[0], b"</" + m[1] + b">", m.end()
        elif not more():
            return
    while True:
        tag = _ROW.search(data, at)
        if not tag:
            at = max(at, data.rfind(b"<"))  # a tag may be cut
            if not more():
                return
            continue
        if base + tag.start() >= hi:
            return
        given = _NUMBER.search(tag[0])
        number = int(given[1]) - 1 if given else number + 1
        if base + tag.start() < lo or tag[0].endswith(b"/>"):
            at = tag.end()
            yield number, [] if base + tag.start() >= lo else None
            continue
        end = re.compile(b"</" + re.match(rb"<([\w.:-]+)", tag[0])[1] + rb"\s*>")
        at = tag.start()
        while not (found := end.search(data, at)):
            if not more():
                raise ReconciliationError("NOT_A_WORKBOOK", "a row that doesn't end")
        row = data[at : found.end()]
        at = found.end()
        yield number, xlsx.row_cells(next(iter(ET.fromstring(root + row + close))), strings)


def range_rows(r: Range, upto: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """(row_idx, cells) of a range, with the gaps before each of its rows; upto: the first row_idx that isn't asked for."""
    with open_file(r.path) as f:
        if r.kind == "xls":
            yield from _with_gaps(biff.xls_rows(f.read(), r.sheet), r.first, upto)
            return
        with zipfile.ZipFile(f) as book:
            strings: list[str] = []
            if r.kind == "xlsx":
                strings = xlsx.shared_strings(book)
            elif "xl/sharedStrings.bin" in book.namelist():
                with book.open("xl/sharedStrings.bin") as s:
                    strings = biff.xlsb_strings(s)
            with book.open(r.part) as part:
                yield from _with_gaps((biff.xlsb_rows if r.kind == "xlsb" else xml_rows)(part, strings, r.lo, r.hi), r.first, upto)


def _with_gaps(rows: Iterator[tuple[int, list[str] | None]], first: int | None, upto: int | None) -> Iterator[tuple[int, list[str]]]:
    before = None
    for number, cells in rows:
        first = number if first is None else first
        for at in range(number if before is None else before + 1, number + 1) if cells is not None else ():
            if upto is not None and at - first >= upto:
                return
            yield at - first, cells if at == number else []
        before = number


# ---- the data source ----------------------------------------------------------------------------------------------


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.sheet = options["path"], options.get("sheet")
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.upto: int | None = int(options["limit"]) if options.get("limit") else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of row_idx from above end the reading; Spark still applies every filter."""
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("row_idx",):
                bound = int(f.value) + isinstance(f, LessThanOrEqual)
                self.upto = bound if self.upto is None else min(self.upto, bound)
            yield f

    def partitions(self) -> list[Range]:
        return [r for path in list_files(self.path) for r in ranges(path, self.sheet, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[str]]] = []

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array([partition.sheet] * n, pa.string()), pa.array([i for i, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))], schema=_ARROW)

        for row in range_rows(partition, self.upto):
            held.append(row)
            if len(held) == BATCH:
                yield batch()
                held.clear()
        yield batch()


class WorkbookSource(DataSource):
    """Options: path (a file, a folder, a glob), sheet ("*": all; unset: the first), rangeBytes, limit (rows of each sheet)."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, limit: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """source_id, sheet, row_idx, cells of workbooks of any format; see the module."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    options = {"sheet": sheet, "limit": limit, "rangeBytes": range_bytes}
    return spark.read.format("workbooks").options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)
