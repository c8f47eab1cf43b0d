"""Rows of the first sheet of an ``.xls`` workbook (BIFF8 records in a compound file).

The format ends at 65,536 rows and 256 columns, so one task reads a file.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")

# Record types and the texts of error cells.
FORMULA, EOF, DATE_1904, CONTINUE, FILEPASS, BOUNDSHEET, MULRK, RSTRING, XF = 0x06, 0x0A, 0x22, 0x3C, 0x2F, 0x85, 0xBD, 0xD6, 0xE0
SST, LABELSST, NUMBER, LABEL, BOOLERR, STRING, RK, FORMAT, BOF = 0xFC, 0xFD, 0x203, 0x204, 0x205, 0x207, 0x27E, 0x41E, 0x809
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}
_END = 0xFFFFFFFA  # sector numbers from here on end a chain


class BadBook(ValueError):
    pass


def workbook_stream(content: bytes) -> bytes:
    """The stream named Workbook of a compound file, put together along its chain of sectors."""
    if content[:8] != MAGIC:
        raise BadBook("not a compound file")
    big, small = (1 << s for s in struct.unpack_from("<HH", content, 30))
    first_dir, cutoff, first_small = struct.unpack_from("<I4xII", content, 48)
    more = struct.unpack_from("<I", content, 68)[0]
    numbers = f"<{big // 4}I"

    def sector(n: int) -> bytes:
        data = content[(n + 1) * big : (n + 2) * big]
        return data + bytes(big - len(data))  # the last one may be cut short

    tables = list(struct.unpack_from("<109I", content, 76))
    while more < _END and len(tables) * big < len(content) + 128 * big:
        *some, more = struct.unpack(numbers, sector(more))
        tables += some
    links = [x for n in tables if n < _END for x in struct.unpack(numbers, sector(n))]

    def chain(n: int, follow: list[int]) -> Iterator[int]:
        for _ in range(len(follow)):  # a chain that runs in a circle ends here
            if n >= _END:
                return
            yield n
            n = follow[n]
        raise BadBook("sectors in a circle")

    def whole(n: int) -> bytes:
        return b"".join(map(sector, chain(n, links)))

    entries = whole(first_dir)
    root, found = None, None
    for at in range(0, len(entries) - 127, 128):
        size, kind = struct.unpack_from("<HB", entries, at + 64)
        name = entries[at : at + max(0, size - 2)].decode("utf-16-le", "replace")
        place = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            root = place
        elif kind == 2 and name.lower() == "workbook":
            found = place
    if found is None or root is None:
        raise BadBook("no workbook of this version")
    start, size = found
    if size >= cutoff:
        return whole(start)[:size]
    short, pieces = whole(root[0]), whole(first_small)
    follow = [x for (x,) in struct.iter_unpack("<I", pieces)]
    return b"".join(short[n * small : (n + 1) * small] for n in chain(start, follow))[:size]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Type and data of each record up to the end of its part; CONTINUE records are more data of the one before."""
    kind, held, depth = None, [], 0
    while at + 4 <= len(stream):
        k, size = struct.unpack_from("<HH", stream, at)
        data, at = stream[at + 4 : at + 4 + size], at + 4 + size
        if k == CONTINUE and held:
            held.append(data)
            continue
        if kind is not None:
            yield kind, held
        depth += (k == BOF) - (k == EOF)  # charts stand inside a sheet as parts of their own
        kind, held = k, [data]
        if k == EOF and depth <= 0:
            return
    if kind is not None:
        yield kind, held
    raise BadBook("cut off")


class _Strings:
    """Reads strings from data in several records; a new record begins with the width of its characters."""

    def __init__(self, parts: list[bytes], at: int):
        self.parts, self.no, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.no]):
                self.no, self.at = self.no + 1, 0
            piece = self.parts[self.no][self.at : self.at + n - len(out)]
            out, self.at = out + piece, self.at + len(piece)
        return out

    def text(self, length_bytes: int = 2) -> str:
        left = int.from_bytes(self.take(length_bytes), "little")
        flags = self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        wide, out = flags & 1, []
        while left:
            if self.at >= len(self.parts[self.no]):
                self.no, self.at = self.no + 1, 1
                wide = self.parts[self.no][0] & 1
            n = min(left, (len(self.parts[self.no]) - self.at) // (2 if wide else 1))
            if not n:
                raise BadBook("half a character")
            out.append(self.take(n * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "surrogatepass"))
            left -= n
        self.take(4 * runs + extra)
        return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _rk(raw: int) -> float:
    value = (raw >> 2) - ((raw >> 31) << 30) if raw & 2 else struct.unpack("<d", struct.pack("<II", 0, raw & 0xFFFFFFFC))[0]
    return value / 100 if raw & 1 else float(value)


def cells_of(stream: bytes, shown: object, is_date: object) -> Iterator[tuple[int, int, str]]:
    """Row, column and text of the filled cells of the first sheet.

    ``shown(number, is a date, epoch)`` gives a number's text, and
    ``is_date(format code, texts of own formats)`` tells whether it is a date.
    """
    shared, formats, codes, epoch, sheet = [], {}, [], dt.datetime(1899, 12, 30), None
    for kind, parts in records(stream):
        data = parts[0]
        if kind == BOF and struct.unpack_from("<H", data)[0] != 0x600:
            raise BadBook("another version")
        if kind == FILEPASS:
            raise BadBook("encrypted")
        if kind == DATE_1904 and data[:1] == b"\x01":
            epoch = dt.datetime(1904, 1, 1)
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", data)[0]] = _Strings(parts, 2).text()
        elif kind == XF:
            codes.append(struct.unpack_from("<H", data, 2)[0])
        elif kind == BOUNDSHEET and sheet is None and data[5] == 0:
            sheet = struct.unpack_from("<I", data)[0]
        elif kind == SST:
            reader = _Strings(parts, 8)
            shared = [reader.text() for _ in range(struct.unpack_from("<I", data, 4)[0])]
    if sheet is None:
        raise BadBook("no sheet")
    dates = [is_date(code, formats) for code in codes]

    def number(value: float, xf: int) -> str:
        return shown(repr(value), xf < len(dates) and dates[xf], epoch)

    waiting = None  # the cell of a formula whose text comes in the next record
    for kind, parts in records(stream, sheet):
        data = parts[0]
        if kind == STRING and waiting:
            yield *waiting, _Strings(parts, 0).text()
            waiting = None
        if kind not in (FORMULA, LABELSST, NUMBER, LABEL, RSTRING, RK, MULRK, BOOLERR):
            continue
        row, col, xf = struct.unpack_from("<HHH", data)
        if kind == LABELSST:
            yield row, col, shared[struct.unpack_from("<I", data, 6)[0]]
        elif kind == NUMBER:
            yield row, col, number(struct.unpack_from("<d", data, 6)[0], xf)
        elif kind == RK:
            yield row, col, number(_rk(struct.unpack_from("<I", data, 6)[0]), xf)
        elif kind == MULRK:
            for k in range((len(data) - 6) // 6):
                xf, raw = struct.unpack_from("<HI", data, 4 + 6 * k)
                yield row, col + k, number(_rk(raw), xf)
        elif kind in (LABEL, RSTRING):
            yield row, col, _Strings(parts, 6).text()
        elif kind == BOOLERR:
            yield row, col, ERRORS.get(data[6], "") if data[7] else str(data[6] == 1)
        elif data[12:14] != b"\xff\xff":  # a formula with a number
            yield row, col, number(struct.unpack_from("<d", data, 6)[0], xf)
        elif data[6] == 0:
            waiting = row, col
        elif data[6] == 1:
            yield row, col, str(data[8] == 1)
        elif data[6] == 2:
            yield row, col, ERRORS.get(data[8], "")


def filled_rows(content: bytes, shown: object, is_date: object) -> dict[int, dict[int, str]]:
    """Texts by row and column; cells without text are left out."""
    rows: dict[int, dict[int, str]] = {}
    for row, col, text in cells_of(workbook_stream(content), shown, is_date):
        if text:
            rows.setdefault(row, {})[col] = text
    return rows
