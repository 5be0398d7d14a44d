"""Cells of the binary workbook formats: .xls (BIFF8 records in an OLE2 file) and .xlsb (BIFF12 records in a zip part).

Both are read record by record; a row is held at a time, the shared strings of a workbook in whole. Cells become the same
texts as those of .xlsx (xlsx.cell_text): whole numbers without a fraction, dates as serial numbers, errors marked.
Encrypted workbooks and formats before BIFF8 are refused.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Sequence
from itertools import groupby
from math import inf

from ledgerloom.plans.model import ReconciliationError
from ledgerloom.sources.xlsx import cell_text

# Fixed values of the formats.
OLE_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END_OF_CHAIN = 0xFFFFFFFE
MINI_LIMIT = 4096
BIFF8 = 0x0600
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
# BIFF8 records
BOF, EOF, BOUNDSHEET, FILEPASS, SST, CONTINUE = 0x809, 0x0A, 0x85, 0x2F, 0xFC, 0x3C
NUMBER, RK, MULRK, LABELSST, LABEL, BOOLERR, FORMULA, STRING = 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x205, 0x06, 0x207
# BIFF12 records
ROW_HDR, CELL_RK, CELL_ERROR, CELL_BOOL, CELL_REAL, CELL_ST, CELL_ISST, FMLA_STRING, FMLA_NUM, FMLA_BOOL, FMLA_ERROR, SST_ITEM, BUNDLE_SH = 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 19, 156

Cell = tuple[int, int, str]


def _number(x: float) -> str:
    return cell_text("n", repr(x), [])


def _rk(v: int) -> str:
    """A number in 32 bits: an integer or the upper half of a double, perhaps a hundred times too large."""
    x = float(v >> 2 if v < 1 << 31 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return _number(x / 100 if v & 1 else x)


def _error(code: int) -> str:
    return cell_text("e", ERRORS.get(code, f"#{code}"), [])


# ---- OLE2 ---------------------------------------------------------------------------------------------------------


def ole_stream(raw: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """A stream of an OLE2 file, by following its chain of sectors; short streams lie in the root's stream of small sectors."""
    if raw[:8] != OLE_MAGIC:
        raise ReconciliationError("NOT_A_WORKBOOK", "no OLE2 file")
    shift, mini_shift = struct.unpack_from("<HH", raw, 30)
    first_dir, first_mini, first_difat = (struct.unpack_from("<I", raw, at)[0] for at in (48, 60, 68))
    size = 1 << shift
    sector = lambda i: raw[(i + 1) << shift : (i + 2) << shift]
    fat_sectors = list(struct.unpack_from("<109I", raw, 76))
    while first_difat < END_OF_CHAIN:
        *more, first_difat = struct.unpack(f"<{size // 4}I", sector(first_difat))
        fat_sectors += more
    fat = [x for i in fat_sectors if i < END_OF_CHAIN for x in struct.unpack(f"<{size // 4}I", sector(i))]

    def chain(start: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table) + 1):
            if start >= END_OF_CHAIN or start >= len(table):
                return
            yield start
            start = table[start]
        raise ReconciliationError("NOT_A_WORKBOOK", "a chain of sectors that doesn't end")

    whole = lambda start: b"".join(map(sector, chain(start, fat)))
    entries = whole(first_dir)
    found, root = {}, (END_OF_CHAIN, 0)
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        start, count = struct.unpack_from("<IQ", entries, at + 116)
        if kind == 5:
            root = (start, count)
        elif kind == 2:
            found[name] = (start, count & 0xFFFFFFFF if shift == 9 else count)
    asked = next((found[n] for n in names if n in found), None)
    if asked is None:
        raise ReconciliationError("NOT_A_WORKBOOK", "no workbook stream")
    start, count = asked
    if count >= MINI_LIMIT:
        return whole(start)[:count]
    minis = whole(first_mini)
    small, mini_fat = whole(root[0]), list(struct.unpack(f"<{len(minis) // 4}I", minis))
    return b"".join(small[i << mini_shift : (i + 1) << mini_shift] for i in chain(start, mini_fat))[:count]


# ---- BIFF8 --------------------------------------------------------------------------------------------------------


def _records(book: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(book):
        kind, n = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + n]
        at += 4 + n


class _Parts:
    """A record's data and that of the CONTINUE records after it. A text that is cut starts anew with a byte of flags."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def _next(self) -> None:
        while self.at >= len(self.parts[self.i]) and self.i + 1 < len(self.parts):
            self.i, self.at = self.i + 1, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            self._next()
            got = self.parts[self.i][self.at : self.at + n - len(out)]
            if not got:
                raise ReconciliationError("NOT_A_WORKBOOK", "shared strings end early")
            out += got
            self.at += len(got)
        return out

    def text(self, n: int, wide: bool) -> str:
        out = ""
        while True:
            part = self.parts[self.i]
            k = min(n, (len(part) - self.at) // (1 + wide))
            out += part[self.at : self.at + k * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")
            self.at, n = self.at + k * (1 + wide), n - k
            if not n:
                return out
            if self.i + 1 >= len(self.parts):
                raise ReconciliationError("NOT_A_WORKBOOK", "a shared string ends early")
            self.i, self.at = self.i + 1, 1
            wide = bool(self.parts[self.i][0] & 1)


def _long_text(p: _Parts) -> str:
    """A text with its length in two bytes, flags, and perhaps the runs of its fonts and phonetics after it."""
    n, flags = struct.unpack("<HB", p.take(3))
    runs = struct.unpack("<H", p.take(2))[0] if flags & 8 else 0
    extra = struct.unpack("<I", p.take(4))[0] if flags & 4 else 0
    text = p.text(n, bool(flags & 1)) if n else ""
    p.take(4 * runs + extra)
    return text


def xls_globals(book: bytes) -> tuple[dict[str, int], list[str]]:
    """Sheet name -> place of its records, in workbook order; the shared strings."""
    sheets: dict[str, int] = {}
    shared: list[bytes] = []
    open_sst = False
    for i, (kind, data) in enumerate(_records(book)):
        if i == 0 and (kind != BOF or struct.unpack_from("<H", data)[0] != BIFF8):
            raise ReconciliationError("UNSUPPORTED_FORMAT", "a workbook older than BIFF8")
        if kind == FILEPASS:
            raise ReconciliationError("UNSUPPORTED_FORMAT", "an encrypted workbook")
        if kind == BOUNDSHEET and data[5] == 0:  # worksheets only
            n, flags = data[6], data[7]
            sheets[data[8 : 8 + n * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1")] = struct.unpack_from("<I", data)[0]
        if kind == SST or (kind == CONTINUE and open_sst):
            shared.append(data)
        open_sst = kind == SST or (kind == CONTINUE and open_sst)
        if kind == EOF:
            break
    if not shared:
        return sheets, []
    p = _Parts(shared)
    count = struct.unpack("<II", p.take(8))[1]
    return sheets, [_long_text(p) for _ in range(count)]


def _xls_cells(book: bytes, at: int, strings: list[str]) -> Iterator[Cell]:
    depth, waiting = 0, None
    for kind, d in _records(book, at):
        if kind == BOF:
            depth += 1
        elif kind == EOF:
            depth -= 1
            if not depth:
                return
        elif depth > 1 or kind not in (NUMBER, RK, MULRK, LABELSST, LABEL, BOOLERR, FORMULA, STRING):
            continue
        elif kind == STRING:
            if waiting:
                yield (*waiting, cell_text("str", _long_text(_Parts([d])), []))
            waiting = None
        else:
            row, col = struct.unpack_from("<HH", d)
            if kind == NUMBER:
                yield row, col, _number(struct.unpack_from("<d", d, 6)[0])
            elif kind == RK:
                yield row, col, _rk(struct.unpack_from("<I", d, 6)[0])
            elif kind == MULRK:
                for j in range((len(d) - 6) // 6):
                    yield row, col + j, _rk(struct.unpack_from("<I", d, 6 + 6 * j)[0])
            elif kind == LABELSST:
                yield row, col, cell_text("str", strings[struct.unpack_from("<I", d, 6)[0]], [])
            elif kind == LABEL:
                yield row, col, cell_text("str", _long_text(_Parts([d[6:]])), [])
            elif kind == BOOLERR:
                yield row, col, _error(d[6]) if d[7] else cell_text("b", str(d[6]), [])
            elif d[12:14] != b"\xff\xff":
                yield row, col, _number(struct.unpack_from("<d", d, 6)[0])
            elif d[6] == 0:
                waiting = row, col
            elif d[6] in (1, 2):
                yield row, col, cell_text("b", str(d[8]), []) if d[6] == 1 else _error(d[8])


def xls_rows(raw: bytes, sheet: str) -> Iterator[tuple[int, list[str]]]:
    """(row's number in the sheet from 0, cells) of every row with a cell."""
    book = ole_stream(raw)
    sheets, strings = xls_globals(book)
    cells = sorted(_xls_cells(book, sheets[sheet], strings), key=lambda c: c[:2])  # of 65,536 rows at most, in any order
    for number, row in groupby(cells, key=lambda c: c[0]):
        out: list[str] = []
        for _, col, text in row:
            out += [""] * (col - len(out)) + [text]
        yield number, out


# ---- BIFF12 -------------------------------------------------------------------------------------------------------


def records12(f: io.BufferedIOBase) -> Iterator[tuple[int, int, bytes]]:
    """(place, type, data) of the records of a part; type and length take as many bytes as they need, seven bits each."""
    at = 0
    while head := f.read(1):
        kind, used = head[0], 1
        if kind & 0x80:
            kind, used = (kind & 0x7F) | (f.read(1)[0] << 7), 2
        n = shift = 0
        while True:
            b = f.read(1)[0]
            n, shift, used = n | (b & 0x7F) << shift, shift + 7, used + 1
            if not b & 0x80 or shift == 28:
                break
        yield at, kind, f.read(n)
        at += used + n


def _wide(d: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", d, at)[0]
    n = 0 if n == 0xFFFFFFFF else n
    return d[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def xlsb_sheets(f: io.BufferedIOBase, targets: dict[str, str]) -> dict[str, str]:
    """Sheet name -> its part; targets: relation -> part."""
    out = {}
    for _, kind, d in records12(f):
        if kind == BUNDLE_SH:
            relation, at = _wide(d, 8)
            out[_wide(d, at)[0]] = targets[relation]
    return out


def xlsb_strings(f: io.BufferedIOBase) -> list[str]:
    return [_wide(d, 1)[0] for _, kind, d in records12(f) if kind == SST_ITEM]


def xlsb_rows(f: io.BufferedIOBase, strings: Sequence[str], lo: int = 0, hi: float = inf) -> Iterator[tuple[int, list[str] | None]]:
    """(number from 0, cells) of the rows whose header lies in [lo, hi) of a part; rows before lo come without cells."""
    number, row = None, None
    for at, kind, d in records12(f):
        if kind == ROW_HDR:
            if number is not None:
                yield number, row
            if at >= hi:
                return
            number, row = struct.unpack_from("<I", d)[0], [] if at >= lo else None
        elif row is not None and CELL_RK <= kind <= FMLA_ERROR:
            row += [""] * (struct.unpack_from("<I", d)[0] - len(row))
            if kind == CELL_RK:
                row.append(_rk(struct.unpack_from("<I", d, 8)[0]))
            elif kind in (CELL_ERROR, FMLA_ERROR):
                row.append(_error(d[8]))
            elif kind in (CELL_BOOL, FMLA_BOOL):
                row.append(cell_text("b", str(d[8]), []))
            elif kind in (CELL_REAL, FMLA_NUM):
                row.append(_number(struct.unpack_from("<d", d, 8)[0]))
            elif kind == CELL_ISST:
                row.append(cell_text("str", strings[struct.unpack_from("<I", d, 8)[0]], []))
            else:
                row.append(cell_text("str", _wide(d, 8)[0], []))
    if number is not None:
        yield number, row
