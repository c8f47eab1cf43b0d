"""Scan the first sheet of ``.xlsx`` and ``.xls`` workbooks into ``file, row_idx, cells``.

A workbook is one compressed archive, so a file is read by one task; the
format itself ends at 1,048,576 rows per sheet.  What kind of workbook a file
is, its first bytes tell.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import IO
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll.runtime import file_uri, written
from musterroll.sources import oldbook
from musterroll.sources.delimited import Scan

UNREADABLE = "Unreadable workbook"

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BUILT_IN_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_SCHEMA = pa.schema([("file", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string())), ("problem", pa.string())])
_BATCH = 4096


def _texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def _is_date(code: int, custom: dict[int, str]) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(code, ""))
    return code in _BUILT_IN_DATES or (code in custom and bool(re.search("[dmyhs]", bare.lower())))


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{_NS}numFmt")}

    formats = root.find(f"{_NS}cellXfs")
    return [] if formats is None else [_is_date(int(x.get("numFmtId", "0")), custom) for x in formats]


def _number(text: str, is_date: bool, epoch: dt.datetime) -> str:
    value = float(text)
    if is_date:
        moment = epoch + dt.timedelta(seconds=round(value * 86400))
        return str(moment.time()) if 0 <= value < 1 else str(moment)
    return str(int(value)) if value.is_integer() else str(value)


def _cell(node: ET.Element, shared: list[str], dates: list[bool], epoch: dt.datetime) -> str:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return _texts(node)
    value = node.find(f"{_NS}v")
    if value is None or value.text is None:
        return ""
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return str(value.text == "1")
    if kind in ("str", "e", "d"):
        return value.text
    style = int(node.get("s", "0"))
    return _number(value.text, style < len(dates) and dates[style], epoch)


def _column(ref: str) -> int:
    out = 0
    for letter in re.match("[A-Z]+", ref).group():
        out = out * 26 + ord(letter) - 64
    return out - 1


def _filled(sheet: IO[bytes], shared: list[str], dates: list[bool], epoch: dt.datetime) -> Iterator[tuple[int, list[str]]]:
    """Position and cells of the rows a sheet holds, cut after the last filled cell."""
    at, parent = -1, None
    for event, node in ET.iterparse(sheet, ("start", "end")):
        if node.tag == f"{_NS}sheetData" and event == "start":
            parent = node
        if node.tag != f"{_NS}row" or event == "start":
            continue
        at = int(node.get("r", at + 2)) - 1
        row: list[str] = []
        for cell in node.iter(f"{_NS}c"):
            col = _column(cell.get("r")) if cell.get("r") else len(row)
            row.extend("" for _ in range(col - len(row)))
            row.append(_cell(cell, shared, dates, epoch))
        while row and row[-1] == "":
            row.pop()
        yield at, row
        if parent is not None:
            parent.clear()


def _old_rows(content: bytes) -> Iterator[list[str]]:
    rows = oldbook.filled_rows(content, _number, _is_date)
    width = max((max(cells) for cells in rows.values()), default=-1) + 1
    for at in range(max(rows, default=-1) + 1):
        cells = rows.get(at, {})
        yield [cells.get(col, "") for col in range(width)]


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet, cut after the last filled cell and row, all one width.

    The sheet is read twice: for its size, and for its rows one by one.
    """
    if content[:8] == oldbook.MAGIC:
        yield from _old_rows(content)
        return
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [_texts(s) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
    main = ET.fromstring(book.read("xl/workbook.xml"))
    first = main.find(f"{_NS}sheets")[0].get(_REL)
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[first].lstrip("/")
    dates = _date_styles(book)
    settings = main.find(f"{_NS}workbookPr")
    late = settings is not None and settings.get("date1904") in ("1", "true")
    epoch = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
    name = target if target.startswith("xl/") else f"xl/{target}"
    width, last = 0, -1
    with book.open(name) as sheet:
        for at, row in _filled(sheet, shared, dates, epoch):
            if row:
                width, last = max(width, len(row)), max(last, at)
    blank, expected = [""] * width, 0
    with book.open(name) as sheet:
        for at, row in _filled(sheet, shared, dates, epoch):
            if at > last:
                break
            for _ in range(expected, at):
                yield blank
            yield row + [""] * (width - len(row))
            expected = at + 1


def _batches(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    start, rows = 0, sheet_rows(content)
    while part := list(islice(rows, _BATCH)):
        n = len(part)
        columns = [pa.array([path] * n), pa.array(range(start, start + n), pa.int64()), pa.array(part, pa.list_(pa.string())), pa.nulls(n, pa.string())]
        yield pa.record_batch(columns, schema=_SCHEMA)
        start += n


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                yield from _batches(path, content.as_py())
            except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, AttributeError, TypeError, OverflowError, zlib.error, struct.error) as e:
                row = [[path], [None], [None], [f"{UNREADABLE}: {type(e).__name__}"]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(row, _SCHEMA)], schema=_SCHEMA)


def read_workbooks(files: DataFrame) -> DataFrame:
    """Rows of workbooks given as ``path, content``; a broken one ends with a row that has a ``problem``."""
    return files.select("path", "content").mapInArrow(_read, "file string, row_idx bigint, cells array<string>, problem string")


def read_workbook_folder(spark: SparkSession, path: str | list[str], glob: str = "*.xlsx") -> Scan:
    """All workbooks under ``path``; one that breaks off anywhere is rejected whole."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    files = reader.load(path).select(file_uri(F.col("_metadata.file_path")).alias("path"), "content")
    rows = written(read_workbooks(files), "workbooks")
    rejected = rows.filter(F.col("problem").isNotNull()).select("file", F.col("problem").alias("reason"))
    return Scan(rows.join(rejected.select("file"), "file", "left_anti").drop("problem"), rejected)


def scan_workbooks(spark: SparkSession, path: str | list[str], glob: str = "*.xlsx") -> DataFrame:
    """``file, row_idx, cells`` of the workbooks that can be read."""
    return read_workbook_folder(spark, path, glob).cells
