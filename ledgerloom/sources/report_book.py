"""Report workbooks whose sheets are written by tasks.

Each task turns the rows of its partitions into the sheet's XML and packs it, a slice at a time. A slice is a piece of a
deflate stream that ends on a byte (a full flush) and refers to nothing before it, so slices in a row are one stream. The
driver only joins them: it writes packed bytes, adds up lengths and check sums, and never sees a row. A table with more
rows than a sheet may hold goes on in further sheets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import report
from ledgerloom.operators.ordering import number_rows
from ledgerloom.session import materialise
from ledgerloom.sources import xlsx

#: Text that a slice holds at most before it is packed.
SLICE_BYTES = 4 << 20
#: Ends a deflate stream: an empty last block.
STREAM_END = b"\x03\x00"
_ZEROS = bytes(1 << 20)
_SLICE = "sheet int, first bigint, crc bigint, size bigint, packed binary"


def crc_of_both(a: int, b: int, size: int) -> int:
    """The CRC-32 of two texts in a row, from theirs and the second one's length."""
    moved, zero = a, 0
    while size:
        n = min(size, len(_ZEROS))
        moved, zero, size = zlib.crc32(_ZEROS[:n], moved), zlib.crc32(_ZEROS[:n], zero), size - n
    return moved ^ zero ^ b


def pack(text: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(text) + z.flush(zlib.Z_FULL_FLUSH)


class Member:
    """A file of the archive, of slices that follow each other."""

    def __init__(self, name: str, at: int):
        self.name, self.at, self.crc, self.size, self.packed = name.encode(), at, 0, 0, 0

    def add(self, crc: int, size: int, packed: int) -> None:
        self.crc, self.size, self.packed = crc_of_both(self.crc, crc, size), self.size + size, self.packed + packed


class Archive:
    """A ZIP file to which packed slices are written as they come; sizes stand behind each member and in the directory."""

    def __init__(self, out: BinaryIO):
        self.out, self.members, self.at = out, [], 0

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        self.members.append(Member(name, self.at))
        raw = self.members[-1].name
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 8, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def slice(self, crc: int, size: int, packed: bytes) -> None:
        self.members[-1].add(crc, size, len(packed))
        self._write(packed)

    def text(self, text: str) -> None:
        raw = text.encode()
        self.slice(zlib.crc32(raw), len(raw), pack(raw))

    def end(self) -> None:
        m = self.members[-1]
        m.add(0, 0, len(STREAM_END))
        self._write(STREAM_END + struct.pack("<IIQQ", 0x08074B50, m.crc, m.packed, m.size))

    def file(self, name: str, text: str) -> None:
        self.begin(name)
        self.text(text)
        self.end()

    def close(self) -> None:
        start = self.at
        for m in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.at)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 8, 0, 0x21, m.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(m.name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + m.name + extra)
        n, size, end = len(self.members), self.at - start, self.at
        self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def slices(numbered: DataFrame, columns: list[str], at: str, per_sheet: int = xlsx.MAX_ROWS - 1, size: int = SLICE_BYTES) -> DataFrame:
    """Packed rows of sheets: sheet (from 0), first (place of the slice), crc, size, packed.

    numbered has a column `at` with each row's place, 1 to n, and its partitions hold rows in that order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        sheet = first = length = 0

        def packed() -> pa.RecordBatch:
            raw = "".join(held).encode()
            values = [[sheet], [first], [zlib.crc32(raw)], [len(raw)], [pack(raw)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["sheet", "first", "crc", "size", "packed"])

        for batch in batches:
            for place, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                mine, row = divmod(place - 1, per_sheet)
                if held and (mine != sheet or length >= size):
                    yield packed()
                    held, length = [], 0
                if not held:
                    sheet, first = mine, place
                held.append(xlsx.row_xml(row + 2, [float(v) if hasattr(v, "as_tuple") else v for v in values]))
                length += len(held[-1])
        if held:
            yield packed()

    return numbered.select(F.col(f"`{at}`"), *[F.col(f"`{c}`") for c in columns]).mapInArrow(run, _SLICE)


def write_book(path: str | Path, small: dict[str, Iterable[Iterable[object]]], large: dict[str, tuple[DataFrame, str, list[str]]], per_sheet: int = xlsx.MAX_ROWS - 1) -> dict[str, int]:
    """A workbook of small sheets (rows) and large ones (frame, its column of places, the columns to show). Rows of each large one."""
    names, parts, rows = list(small), [], {}
    for name, (df, at, columns) in large.items():
        packed = materialise(slices(df, columns, at, per_sheet), "report")
        rows[name] = df.count()
        sheets = max(1, -(-rows[name] // per_sheet))
        parts.append((packed, columns, sheets))
        names += [name if i == 0 else f"{name[:25]} ({i + 1})" for i in range(sheets)]
    with open(path, "wb") as f:
        z = Archive(f)
        for name, text in xlsx.book_parts(names).items():
            z.file(name, text)
        number = 1
        for sheet in small.values():
            z.begin(f"xl/worksheets/sheet{number}.xml")
            for part in xlsx.sheet_xml(sheet):
                z.text(part)
            z.end()
            number += 1
        for packed, columns, sheets in parts:
            found = packed.orderBy("sheet", "first").toLocalIterator()  # packed bytes, a partition at a time
            row = next(found, None)
            for i in range(sheets):
                z.begin(f"xl/worksheets/sheet{number}.xml")
                z.text(xlsx.SHEET_HEAD + xlsx.row_xml(1, columns))
                while row is not None and row["sheet"] == i:
                    z.slice(row["crc"], row["size"], bytes(row["packed"]))
                    row = next(found, None)
                z.text(xlsx.SHEET_TAIL)
                z.end()
                number += 1
        z.close()
    return rows


def export_report(frames, path: str | Path, primary_name: str = "", per_sheet: int = xlsx.MAX_ROWS - 1) -> dict:
    """The report workbook: overview, differences, everything, numbered and titled; the large sheets are written by tasks."""
    large = {}
    for name, only in (("Sai lech & Can chu y", True), ("Chi tiet tat ca", False)):
        sheet = report.report_sheet(frames, only, primary_name)
        large[name] = (materialise(sheet, "report-rows"), "STT", sheet.columns)
    small = {"Tong quan": xlsx.values_of(report.summary_sheet(frames).orderBy("ord").drop("ord"))}
    rows = write_book(path, small, large, per_sheet)
    return {"path": str(path), "groups": frames.groups.count(), "rows": rows}


def export_table(df: DataFrame, order: list, path: str | Path, name: str = "Sheet1", per_sheet: int = xlsx.MAX_ROWS - 1) -> int:
    """Any table as a workbook, its rows in the given order; the number of rows."""
    at = "__place"
    numbered = number_rows(df, order, at).orderBy(at)
    return write_book(path, {}, {name: (materialise(numbered, "table"), at, df.columns)}, per_sheet)[name]
