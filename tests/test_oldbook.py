"""Workbooks in the old format, record by record."""

import struct

import pytest

from musterroll.plans import books
from musterroll.sources import folder, oldbook, workbook


def cell(kind, row, col, data, xf=0):
    return books.record(kind, struct.pack("<HHH", row, col, xf) + data)


def rk(value, hundredth=False):
    return struct.pack("<I", (value << 2 & 0xFFFFFFFF) | 2 | hundredth)


def test_every_kind_of_cell():
    code = "yyyy-mm"
    styles = books.record(oldbook.FORMAT, struct.pack("<HHB", 170, len(code), 0) + code.encode())
    styles += b"".join(books.record(oldbook.XF, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, 14, 170, 20))
    double = lambda x: struct.pack("<d", x)
    special = lambda kind, value=0: bytes([kind, 0, value, 0, 0, 0]) + b"\xff\xff" + bytes(6)
    cells = [
        cell(oldbook.LABELSST, 0, 0, struct.pack("<I", 1)),
        cell(oldbook.LABELSST, 0, 3, struct.pack("<I", 0)),
        cell(oldbook.NUMBER, 2, 0, double(9.0)),
        cell(oldbook.NUMBER, 2, 1, double(7.5)),
        cell(oldbook.NUMBER, 2, 2, double(37241.0), 1),
        cell(oldbook.NUMBER, 2, 3, double(37241.5), 2),
        cell(oldbook.RK, 3, 0, rk(-12)),
        cell(oldbook.RK, 3, 1, rk(1234, True)),
        books.record(oldbook.MULRK, struct.pack("<HH", 3, 2) + struct.pack("<H", 0) + rk(5) + struct.pack("<H", 1) + rk(37241) + struct.pack("<H", 3)),
        cell(oldbook.BOOLERR, 4, 0, b"\x01\x00"),
        cell(oldbook.BOOLERR, 4, 1, b"\x2a\x01"),
        cell(oldbook.FORMULA, 4, 2, double(2.25) + bytes(6)),
        cell(oldbook.FORMULA, 4, 3, special(0)),
        books.record(oldbook.STRING, struct.pack("<HB", 4, 0) + "caf\xe9".encode("latin-1")),
        cell(oldbook.FORMULA, 5, 0, special(1, 1)),
        cell(oldbook.FORMULA, 5, 1, special(2, 7)),
        cell(oldbook.FORMULA, 5, 2, special(3)),
        cell(oldbook.LABEL, 5, 3, struct.pack("<HB", 2, 1) + "żx".encode("utf-16-le")),
        cell(oldbook.NUMBER, 6, 0, double(0.25), 3),
    ]
    rows = list(workbook.sheet_rows(books.compound(books.stream(cells, ["last", "first"], styles))))
    assert rows == [
        ["first", "", "", "last"], [""] * 4, ["9", "7.5", "2001-12-16 00:00:00", "2001-12-16 12:00:00"],
        ["-12", "12.34", "5", "2001-12-16 00:00:00"], ["True", "#N/A", "2.25", "caf\xe9"], ["True", "#DIV/0!", "", "żx"], ["06:00:00", "", "", ""],
    ]
    late = books.record(oldbook.DATE_1904, b"\x01\x00") + styles
    assert list(workbook.sheet_rows(books.compound(books.stream(cells[4:5], ["x"], late))))[2][2] == "2005-12-17 00:00:00"


@pytest.mark.parametrize("length", [1, 10, 4000, 5000, 30_000])
def test_texts_across_records_and_sectors(length):
    rows = [[f"{i}" + "é\U0001f600z"[i % 3] * (length // (1 + i % 2)), "", str(i)] for i in range(12)]
    assert list(workbook.sheet_rows(books.old_workbook(rows))) == rows


def test_narrow_text_goes_on_as_wide_and_formatting_is_passed_over():
    first = struct.pack("<IIHB", 2, 2, 6, 0) + b"abc"
    second = b"\x01" + "dłf".encode("utf-16-le") + struct.pack("<HBHI", 2, 0x0C, 1, 3) + b"gh" + bytes(7)
    parts = [first, second]
    reader = oldbook._Strings(parts, 8)
    assert [reader.text(), reader.text()] == ["abcdłf", "gh"]


def test_long_chain_of_sectors():
    """More than 109 tables of links, so that they go on outside the header."""
    data = bytes(range(256)) * 4 * 8000
    assert oldbook.workbook_stream(books.compound(data)) == data


def test_broken_books_are_rejected(spark, tmp_path):
    good = books.old_workbook([["a", "b"], ["c", "d"]])
    big = books.old_workbook([[f"text {i} {j}" for j in range(20)] for i in range(200)])
    (tmp_path / "good.XLS").write_bytes(good)
    (tmp_path / "cut.xls").write_bytes(big[: len(big) // 3])
    (tmp_path / "head.xls").write_bytes(big[:300])
    circle = bytearray(big)
    fat = 512 * (1 + struct.unpack_from("<I", big, 76)[0])
    circle[fat + 4 * 3 : fat + 4 * 4] = struct.pack("<I", 2)
    (tmp_path / "circle.xls").write_bytes(circle)
    (tmp_path / "text.xls").write_bytes(b"a,b\n")
    locked = books.stream([], ["x"], books.record(oldbook.FILEPASS, bytes(6)))
    (tmp_path / "locked.xls").write_bytes(books.compound(locked))
    scan = folder.scan_folder(spark, str(tmp_path))
    assert [r.cells for r in scan.cells.orderBy("row_idx").collect()] == [["a", "b"], ["c", "d"]]
    assert {r.file.rsplit("/", 1)[1] for r in scan.rejected.collect()} == {"cut.xls", "head.xls", "circle.xls", "text.xls", "locked.xls"}
