"""Workbooks of three formats, written byte by byte, against the streamed reader of .xlsx."""

import io
import random
import struct
import zipfile
from xml.sax.saxutils import escape

import pytest

from ledgerloom.plans.model import ReconciliationError
from ledgerloom.sources import biff, workbooks, xlsx

#: Cells by (row, column): texts, whole, fractional and large numbers, booleans, errors, a formula's text; a gap of rows and one of columns.
CELLS = {
    (2, 0): "Số hóa đơn", (2, 1): "Tiền", (2, 3): "  có khoảng trắng  ", (3, 0): "1C26TAA", (3, 1): 1000, (3, 2): -7, (3, 3): 0.25, (6, 0): 1234567.89, (6, 1): True, (6, 2): False, (6, 4): "#N/A",
    (7, 1): "=Tổng", (7, 2): 12345678901.0, (8, 0): "東京 😀", (8, 5): 3.5,
}
TEXTS = ["ERR:#N/A"]


def expected(cells):
    first, out = min(r for r, _ in cells), []
    for r in range(first, max(r for r, _ in cells) + 1):
        row = []
        for (_, c), v in sorted((k, v) for k, v in cells.items() if k[0] == r):
            text = str(v).lower() if isinstance(v, bool) else f"ERR:{v}" if v == "#N/A" else v.lstrip("=").strip() if isinstance(v, str) else str(int(v)) if v == int(v) else repr(v)
            row += [""] * (c - len(row)) + [text]
        out.append((r - first, row))
    return out


def xlsx_bytes(cells, numbered=True, prefix=""):
    texts = sorted({v for v in cells.values() if isinstance(v, str) and v[0] not in "=#"})
    rows, last = [], None
    for r in sorted({r for r, _ in cells}):
        row = []
        for (_, c), v in sorted((k, v) for k, v in cells.items() if k[0] == r):
            kind, value = ("s", texts.index(v)) if v in texts else ("b", int(v)) if isinstance(v, bool) else ("e", v) if v == "#N/A" else ("str", escape(v[1:])) if isinstance(v, str) else ("n", repr(v))
            row.append(f'<{prefix}c r="{chr(65 + c)}{r + 1}" t="{kind}"><{prefix}v>{value}</{prefix}v></{prefix}c>')
        at = "" if not numbered and last == r - 1 else f" r='{r + 1}'"
        rows.append(f"<{prefix}row{at}>{''.join(row)}</{prefix}row>")
        last = r
    main, ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", f"xmlns{':' + prefix[:-1] if prefix else ''}"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Leer" sheetId="1" r:id="r1"/><sheet name="Sổ" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{escape(t)}</t></si>" for t in texts)}</sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<?xml version="1.0"?><{prefix}worksheet {ns}="{main}"><{prefix}sheetData>{"".join(rows)}</{prefix}sheetData></{prefix}worksheet>')
    return out.getvalue()


# ---- .xlsb


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def rec12(kind, data=b""):
    return (bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])) + varint(len(data)) + data


def wide(text):
    return struct.pack("<I", len(text.encode("utf-16-le")) // 2) + text.encode("utf-16-le")


def rk(v):
    """A number as RK, if it has one."""
    if v == int(v) and abs(v) < 1 << 29:
        return (int(v) << 2 | 2) & 0xFFFFFFFF
    if v * 100 == int(v * 100) and abs(v * 100) < 1 << 29:
        return (int(v * 100) << 2 | 3) & 0xFFFFFFFF
    bits = struct.unpack("<Q", struct.pack("<d", v))[0]
    return bits >> 32 if not bits & 0x3FFFFFFFF else None


def xlsb_bytes(cells):
    texts = sorted({v for v in cells.values() if isinstance(v, str) and v[0] not in "=#"})
    sheet = rec12(129) + rec12(145)
    for r in sorted({r for r, _ in cells}):
        sheet += rec12(0, struct.pack("<I", r) + bytes(13))
        for (_, c), v in sorted((k, v) for k, v in cells.items() if k[0] == r):
            head = struct.pack("<II", c, 0)
            if isinstance(v, bool):
                sheet += rec12(4, head + bytes([v]))
            elif v == "#N/A":
                sheet += rec12(3, head + b"\x2a")
            elif isinstance(v, str):
                sheet += rec12(7, head + struct.pack("<I", texts.index(v))) if v in texts else rec12(8, head + wide(v[1:]) + bytes(10))
            else:
                sheet += rec12(2, head + struct.pack("<I", rk(v))) if rk(v) is not None else rec12(5, head + struct.pack("<d", v))
    sheet += rec12(146) + rec12(130)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.bin", rec12(131) + rec12(156, struct.pack("<II", 0, 1) + wide("r1") + wide("Leer")) + rec12(156, struct.pack("<II", 0, 2) + wide("r2") + wide("Sổ")) + rec12(132))
        z.writestr("xl/_rels/workbook.bin.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.bin"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.bin"/></Relationships>')
        z.writestr("xl/sharedStrings.bin", rec12(159, struct.pack("<II", len(texts), len(texts))) + b"".join(rec12(19, b"\0" + wide(t)) for t in texts) + rec12(160))
        z.writestr("xl/worksheets/sheet1.bin", rec12(129) + rec12(130))
        z.writestr("xl/worksheets/sheet2.bin", sheet)
    return out.getvalue()


# ---- .xls


def rec(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def narrow_or_wide(text, length="<H"):
    try:
        raw, flag = text.encode("latin-1"), 0
    except UnicodeEncodeError:
        raw, flag = text.encode("utf-16-le"), 1
    return struct.pack(length, len(raw) >> flag) + bytes([flag]) + raw


def sst(texts, cut):
    """SST and CONTINUE records, cut after so many bytes at any place; a cut text starts anew with its flags."""
    out, part = [], struct.pack("<II", len(texts), len(texts))
    for i, t in enumerate(texts):
        raw = narrow_or_wide(t)
        flag, chars = raw[2], raw[3:]
        runs = struct.pack("<H", 1) if i % 3 == 0 else b""  # every third text has a run of a font
        head = raw[:2] + bytes([flag | (8 if runs else 0)]) + runs
        if len(part) + len(head) > cut:
            out, part = [*out, part], b""
        part += head
        step = 1 + flag
        for k in range(0, len(chars), step):
            if len(part) + step > cut:
                out, part = [*out, part], bytes([flag])
            part += chars[k : k + step]
        if runs:
            if len(part) + 4 > cut:
                out, part = [*out, part], b""
            part += bytes(4)
    out.append(part)
    return rec(biff.SST, out[0]) + b"".join(rec(biff.CONTINUE, p) for p in out[1:])


def xls_stream(cells, cut=8224):
    texts = sorted({v for v in cells.values() if isinstance(v, str) and v[0] not in "=#"})
    bof = lambda kind: rec(biff.BOF, struct.pack("<HHHHII", biff.BIFF8, kind, 0, 0, 0, 0))
    body = b""
    for r in sorted({r for r, _ in cells}):
        run = []
        for (_, c), v in sorted((k, v) for k, v in cells.items() if k[0] == r):
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(v, bool):
                body += rec(biff.BOOLERR, at + bytes([v, 0]))
            elif v == "#N/A":
                body += rec(biff.BOOLERR, at + b"\x2a\x01")
            elif isinstance(v, str) and v in texts:
                body += rec(biff.LABELSST, at + struct.pack("<I", texts.index(v)))
            elif isinstance(v, str):
                body += rec(biff.FORMULA, at + b"\0" * 6 + b"\xff\xff" + bytes(8)) + rec(biff.STRING, narrow_or_wide(v[1:]))
            elif rk(v) is None:
                body += rec(biff.NUMBER, at + struct.pack("<d", v))
            else:
                run.append((c, rk(v)))
        if len(run) > 1 and [c for c, _ in run] == list(range(run[0][0], run[0][0] + len(run))):
            body += rec(biff.MULRK, struct.pack("<HH", r, run[0][0]) + b"".join(struct.pack("<HI", 0, x) for _, x in run) + struct.pack("<H", run[-1][0]))
        else:
            body += b"".join(rec(biff.RK, struct.pack("<HHHI", r, c, 0, x)) for c, x in run)
    sheets = [bof(0x10) + rec(biff.EOF), bof(0x10) + body + bof(0x20) + rec(biff.NUMBER, bytes(14)) + rec(biff.EOF) + rec(biff.EOF)]  # a chart within the second
    names = [narrow_or_wide(n, "<B") for n in ("Leer", "Sổ")]
    shared = sst(texts, cut) if texts else b""
    places = [len(bof(5)) + sum(4 + 6 + len(n) for n in names) + len(shared) + len(rec(biff.EOF))]
    places.append(places[0] + len(sheets[0]))
    head = bof(5) + b"".join(rec(biff.BOUNDSHEET, struct.pack("<IBB", p, 0, 0) + n) for p, n in zip(places, names, strict=True)) + shared + rec(biff.EOF)
    return head + b"".join(sheets)


def ole(stream, name="Workbook"):
    """An OLE2 file of 512-byte sectors that lie in reverse order; streams under 4096 bytes in small sectors."""
    size, sectors, fat = 512, [], {}

    def put(raw, order=-1):
        n = max(1, -(-len(raw) // size))
        first = len(sectors)
        sectors.extend([b""] * n)
        places = list(range(first, first + n))[::order]
        for i, p in enumerate(places):
            sectors[p] = raw[i * size : (i + 1) * size].ljust(size, b"\0")
            fat[p] = places[i + 1] if i + 1 < n else biff.END_OF_CHAIN
        return places[0]

    entry = lambda n, kind, start, count: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, kind) + bytes(49) + struct.pack("<IQ", start, count)
    mini, mini_fat = biff.END_OF_CHAIN, biff.END_OF_CHAIN
    if len(stream) < biff.MINI_LIMIT:
        n = -(-len(stream) // 64)
        mini = put(stream.ljust(64 * n, b"\0"))
        mini_fat = put(b"".join(struct.pack("<I", i + 1 if i + 1 < n else biff.END_OF_CHAIN) for i in range(n)).ljust(size, b"\xff"))
        start = 0
    else:
        start = put(stream)
    directory = put(entry("Root Entry", 5, mini, 64 * -(-len(stream) // 64)) + entry("Other", 2, biff.END_OF_CHAIN, 0) + entry(name, 2, start, len(stream)) + bytes(128))
    n_fat = 1
    while (len(sectors) + n_fat) * 4 > n_fat * size:
        n_fat += 1
    at = len(sectors)
    table = [fat.get(i, 0xFFFFFFFD) for i in range(at + n_fat)]
    raw = b"".join(struct.pack("<I", x) for x in table).ljust(n_fat * size, b"\xff")
    head = biff.OLE_MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, biff.MINI_LIMIT, mini_fat, 1, biff.END_OF_CHAIN, 0)
    head += b"".join(struct.pack("<I", at + i if i < n_fat else 0xFFFFFFFF) for i in range(109))
    return head + b"".join(sectors) + raw


def many(rows):
    rng = random.Random(rows)
    pick = lambda i: rng.choice((f"văn bản {rng.randrange(50)}", f"t{i}", i, i / 4, rng.random(), True, "#N/A", "=dài " + "x" * rng.randrange(30)))
    return {(r + r // 100, c): pick(r) for r in range(rows) for c in range(6) if rng.random() < 0.8}


FORMATS = {"a.xlsx": xlsx_bytes, "b.xlsb": xlsb_bytes, "c.xls": lambda cells: ole(xls_stream(cells))}


@pytest.mark.parametrize("name", FORMATS)
@pytest.mark.parametrize("cells", [CELLS, many(700)], ids=["few", "many"])
def test_formats_read_the_same(tmp_path, name, cells):
    (tmp_path / name).write_bytes(FORMATS[name](cells))
    for size in (workbooks.RANGE_BYTES, 997):
        parts = workbooks.ranges(str(tmp_path / name), "sổ ", size)
        assert [row for r in parts for row in workbooks.range_rows(r)] == expected(cells)
        assert size > 997 or name == "c.xls" or len(parts) > (cells is not CELLS)
    if name == "a.xlsx":
        assert list(enumerate(xlsx.sheet_rows((tmp_path / name).read_bytes(), "Sổ"))) == expected(cells)


@pytest.mark.parametrize("cut", [16, 17, 18, 33, 64])
def test_shared_strings_cut_anywhere(tmp_path, cut):
    cells = {(i, 0): t for i, t in enumerate(["abc", "dài hơn một chút", "x" * 40, "東京 😀 và nữa", "é" * 30, "z"])}
    (tmp_path / "c.xls").write_bytes(ole(xls_stream(cells, cut)))
    assert [row for r in workbooks.ranges(str(tmp_path / "c.xls"), "Sổ") for row in workbooks.range_rows(r)] == expected(cells)


@pytest.mark.parametrize("numbered", [True, False])
@pytest.mark.parametrize("prefix", ["", "x:"])
def test_rows_of_any_range(numbered, prefix):
    cells = many(60)
    raw = zipfile.ZipFile(io.BytesIO(xlsx_bytes(cells, numbered, prefix))).read("xl/worksheets/sheet2.xml")
    texts = sorted({v for v in cells.values() if isinstance(v, str) and v[0] not in "=#"})
    whole = list(workbooks.xml_rows(io.BytesIO(raw), texts))
    for cut in range(0, len(raw), 37):
        before, after = list(workbooks.xml_rows(io.BytesIO(raw), texts, 0, cut)), list(workbooks.xml_rows(io.BytesIO(raw), texts, cut))
        assert [r for r, _ in after] == [r for r, _ in whole] and before + [x for x in after if x[1] is not None] == whole


def test_spark_reads_all_formats_by_several_tasks(spark, tmp_path):
    cells = many(2000)
    for name, write in FORMATS.items():
        (tmp_path / name).write_bytes(write(cells))
    df = workbooks.read_workbooks(spark, str(tmp_path), "Sổ", range_bytes=50_000)
    assert df.rdd.getNumPartitions() > 6
    got = {}
    for r in df.collect():
        got.setdefault(r.source_id.rsplit("/")[-1], []).append((r.row_idx, r.cells))
    assert {k: sorted(v) for k, v in got.items()} == dict.fromkeys(FORMATS, expected(cells))
    heads = workbooks.read_workbooks(spark, str(tmp_path / "*.xls*"), "*").where("row_idx < 3")
    assert sorted((r.source_id[-4:], r.sheet, r.row_idx) for r in heads.collect()) == [(k[-4:], "Sổ", i) for k in sorted(FORMATS, key=lambda k: k[-4:]) for i in range(3)]
    assert workbooks.read_workbooks(spark, str(tmp_path / "b.xlsb"), "Sổ", limit=7).count() == 7


def test_a_bound_of_rows_ends_the_reading(tmp_path):
    from pyspark.sql.datasource import GreaterThan, LessThan

    reader = workbooks.WorkbookReader({"path": "x"})
    assert len(list(reader.pushFilters([LessThan(("row_idx",), 500), GreaterThan(("row_idx",), 3), LessThan(("sheet",), 2)]))) == 3 and reader.upto == 500


def test_what_is_refused(tmp_path):
    for name, raw in {"plain.xls": b"no workbook at all", "empty.xlsx": b"", "old.xls": ole(rec(biff.BOF, struct.pack("<HH", 0x500, 5)).ljust(5000, b"\0")), "locked.xls": ole((rec(biff.BOF, struct.pack("<HHHHII", biff.BIFF8, 5, 0, 0, 0, 0)) + rec(biff.FILEPASS, bytes(6))).ljust(5000, b"\0")), "other.xls": ole(bytes(5000), "WordDocument")}.items():
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(ReconciliationError):
            workbooks.ranges(str(tmp_path / name), None)
    (tmp_path / "a.xlsx").write_bytes(xlsx_bytes(CELLS))
    with pytest.raises(ReconciliationError):
        workbooks.ranges(str(tmp_path / "a.xlsx"), "Nirgends")
    assert [row for r in workbooks.ranges(str(tmp_path / "a.xlsx"), None) for row in workbooks.range_rows(r)] == []
