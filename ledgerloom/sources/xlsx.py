"""Excel workbooks (.xlsx, .xlsm): distributed reading of many files, inspection, and the report workbook.

Files are scanned by Spark's binaryFile source; each task unzips its own files and streams a sheet's XML row by row, so
one row at a time is held. workbooks.py reads ranges of rows by several tasks, and the binary formats as well.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import infer
from ledgerloom.plans.model import ReconciliationError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a sheet that the format itself can hold.
MAX_ROWS = 1_048_576
PREVIEW_ROWS = 10
#: Fractional numbers are amounts; style 1 shows them by the built-in format 3 (#,##0).
AMOUNT_STYLE = ' s="1"'
BATCH = 2_000
#: Characters that XML can't hold.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def sheet_paths(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> its part, in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[s.get(f"{_REL}id")]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def resolve_sheet(names: Iterable[str], asked: str | None) -> str:
    """A blank name is the first sheet; others match trimmed, case aside; nothing else is guessed."""
    names = list(names)
    if not (asked or "").strip():
        return names[0]
    found = [n for n in names if n.strip().lower() == asked.strip().lower()]
    if not found:
        raise ReconciliationError("SHEET_NOT_FOUND", asked)
    return found[0]


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def cell_text(kind: str, value: str | None, strings: Sequence[str]) -> str:
    """Every cell as text: whole numbers without a fraction, errors marked, dates as their serial number."""
    if value is None:
        return ""
    if kind == "s":
        return strings[int(value)].strip()
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "e":
        return f"ERR:{value}"
    if kind in ("str", "inlineStr"):
        return value.strip()
    number = float(value)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def row_cells(row: ET.Element, strings: Sequence[str]) -> list[str]:
    """The texts of a row's cells, from column A on."""
    out: list[str] = []
    for c in row.iter(f"{_MAIN}c"):
        at = _column(c.get("r")) if c.get("r") else len(out)
        inline = c.find(f"{_MAIN}is")
        v = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else getattr(c.find(f"{_MAIN}v"), "text", None)
        out += [""] * (at - len(out)) + [cell_text(c.get("t", "n"), v, strings)]
    return out


def sheet_rows(content: bytes, sheet: str | None = None, limit: int | None = None) -> Iterator[list[str]]:
    """The rows of a sheet, from its first used one on; gaps are empty texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = sheet_paths(book)
        strings, last, given = shared_strings(book), None, 0
        with book.open(parts[resolve_sheet(parts, sheet)]) as f:
            for _, e in ET.iterparse(f):
                if e.tag != f"{_MAIN}row":
                    continue
                number = int(e.get("r") or (last or 0) + 1)
                for _ in range(number - last - 1 if last is not None else 0):
                    yield []
                    given += 1
                yield row_cells(e, strings)
                last, given = number, given + 1
                e.clear()
                if limit is not None and given >= limit:
                    return


def extent(content: bytes, sheet: str | None = None) -> tuple[int, int, int]:
    """First used row (from 1), rows and columns of the range of a sheet's cells that hold something."""
    low, high = [0, 0], [-1, -1]
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = sheet_paths(book)
        with book.open(parts[resolve_sheet(parts, sheet)]) as f:
            row = 0
            for _, e in ET.iterparse(f):
                if e.tag != f"{_MAIN}row":
                    continue
                row, at = int(e.get("r") or row + 1), -1
                for c in e.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    if c.find(f"{_MAIN}v") is None and c.find(f"{_MAIN}is") is None:
                        continue
                    low = [min(low[0], row), min(low[1], at)] if high[0] >= 0 else [row, at]
                    high = [max(high[0], row), max(high[1], at)]
                e.clear()
    return (low[0], high[0] - low[0] + 1, high[1] - low[1] + 1) if high[0] >= 0 else (1, 0, 0)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, content of workbooks under a path or glob."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")


def read_sheets(spark: SparkSession, path: str, sheet: str | None = None, limit: int | None = None) -> DataFrame:
    """source_id (the file's path), row_idx, cells of one sheet of every workbook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[list[str]] = []
                at = 0
                for row in sheet_rows(content, sheet, limit):
                    held.append(row)
                    if len(held) == BATCH:
                        yield _rows(name, at, held)
                        at, held = at + len(held), []
                yield _rows(name, at, held)

    return files(spark, path).select("path", "content").mapInArrow(run, "source_id string, row_idx bigint, cells array<string>")


def _rows(name: str, at: int, rows: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["source_id", "row_idx", "cells"])


def inspect_workbook(content: bytes, name: str = "") -> dict:
    """Sheets of a workbook with their range, header, columns, mapping, kind and a preview; unreadable sheets are left out.

    header_row and data_start_row count from the range's first row, physical_ ones from the sheet's.
    """
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = list(sheet_paths(book))
    for sheet in names:
        try:
            rows, (first, height, width) = list(sheet_rows(content, sheet, infer.SCAN_ROWS)), extent(content, sheet)
        except (ET.ParseError, KeyError):
            continue
        found = infer.inspect(rows, sheet)
        physical = {f"physical_{k}": first + found[k] - 1 for k in ("header_row", "data_start_row")}
        out.append({"sheet": sheet, "total_rows": height, "total_cols": width, "range_start_row": first, "preview": rows[:PREVIEW_ROWS], **found, **physical})
    return {"name": name, "size": len(content), "sheets": out}


def inspect_files(spark: SparkSession, path: str) -> DataFrame:
    """source_id (the file's path) and inspection, a JSON document, of every workbook; null for files that aren't workbooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = json.dumps(inspect_workbook(content, name.rsplit("/", 1)[-1]), ensure_ascii=False)
                except (zipfile.BadZipFile, ET.ParseError, KeyError):
                    found = None
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([found], pa.string())], ["source_id", "inspection"])

    return files(spark, path).select("path", "content").mapInArrow(run, "source_id string, inspection string")


# The parts of a workbook.
SHEET_HEAD = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
SHEET_TAIL = "</sheetData></worksheet>"


def row_xml(number: int, row: Iterable[object]) -> str:
    cells = []
    for j, v in enumerate(row):
        if v is None:
            continue
        ref = f"{chr(65 + j) if j < 26 else chr(64 + j // 26) + chr(65 + j % 26)}{number}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            cells.append(f'<c r="{ref}"{AMOUNT_STYLE if isinstance(v, float) else ""}><v>{v}</v></c>')
        else:
            cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(v)))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def sheet_xml(rows: Iterable[Iterable[object]]) -> Iterator[str]:
    yield SHEET_HEAD
    for i, row in enumerate(rows, 1):
        if i > MAX_ROWS:
            raise ReconciliationError("SHEET_FULL", f"a sheet holds {MAX_ROWS} rows; report_book.py goes on in further sheets")
        yield row_xml(i, row)
    yield SHEET_TAIL


def book_parts(names: Sequence[str]) -> dict[str, str]:
    """What a workbook holds besides its sheets' rows."""
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    quoted = lambda n: escape(n, {'"': "&quot;"})
    sheets = "".join(f'<sheet name="{quoted(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
    relations = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    xml = '<?xml version="1.0" encoding="UTF-8"?>'
    return {
        "[Content_Types].xml": f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        "_rels/.rels": f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{xml}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relations}<Relationship Id="styles" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{xml}<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="3" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }


def write_workbook(path: str | Path, sheets: dict[str, Iterable[Iterable[object]]]) -> None:
    """A plain workbook of small sheets; rows are streamed into the archive."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in book_parts(list(sheets)).items():
            z.writestr(name, text)
        for i, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                for part in sheet_xml(rows):
                    f.write(part.encode())


def values_of(df: DataFrame) -> Iterator[list[object]]:
    """Titles and rows of a small frame."""
    yield list(df.columns)
    for r in df.toLocalIterator():
        yield [float(v) if hasattr(v, "as_tuple") else v for v in r]


def export_report(frames, path: str | Path, primary_name: str = "") -> dict:
    """The three-sheet report workbook: overview, differences, everything (see report_book.py)."""
    from ledgerloom.sources import report_book

    return report_book.export_report(frames, path, primary_name)


def default_report_path(session_id: str) -> Path:
    home = Path.home() / "Downloads"
    return (home if home.is_dir() else Path("/tmp")) / f"Bao_Cao_Doi_Chieu_{re.sub(r'[^A-Za-z0-9_-]', '_', session_id)}.xlsx"


def safe_csv(df: DataFrame) -> DataFrame:
    """Text columns whose cells can't be taken for formulas by a spreadsheet."""
    text = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[F.when(F.col(c).rlike("^[=+@-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])
