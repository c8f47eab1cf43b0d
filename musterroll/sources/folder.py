"""Scan a folder of mixed files, and write the contract table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll.contract import BY_NAME, CONTRACT
from musterroll.runtime import chunk_of, file_uri, written
from musterroll.sources import named
from musterroll.sources.delimited import Scan, read_delimited
from musterroll.sources.workbook import read_workbook_folder

LINE_END = "\r\n"
NO_DATA = "No data found"
READERS = {"csv": read_delimited, "xlsx": read_workbook_folder, "xls": read_workbook_folder}


def with_reader(files: DataFrame) -> DataFrame:
    """Choose a reader by suffix; ``reason`` says why there is none."""
    suffix = F.lower(F.regexp_extract("file", r"(\.[^./\\]*)$", 1))
    staged = files.withColumn("suffix", suffix)
    known = F.col("suffix").isin(*[f".{k}" for k in READERS])
    return staged.withColumns(
        {
            "reader": F.when(known, F.substring("suffix", 2, 10)),
            "reason": F.when(~known, F.concat(F.lit("Unsupported file format: "), F.col("suffix"))),
        }
    )


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every file and its reader, as a written table; contents are not read.

    Scans leave out files of zero bytes, so the names come from the listing
    that Spark's file index holds on the driver anyway.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = spark.createDataFrame([(name,) for name in listing.inputFiles()], "file string")
    return written(with_reader(names.select(file_uri(F.col("file")).alias("file"))), "listing")


def scan_folder(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> Scan:
    """Rows of all files with a known suffix (any case), and the files that can't be read."""
    files = list_files(spark, path) if files is None else files
    cells = spark.createDataFrame([], "file string, row_idx bigint, cells array<string>")
    rejected = spark.createDataFrame([], "file string, reason string")
    for kind, reader in READERS.items():
        if files.filter(F.col("reader") == kind).isEmpty():
            continue
        glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in kind)
        scan = reader(spark, path, glob)
        cells, rejected = cells.unionByName(scan.cells), rejected.unionByName(scan.rejected)
    return Scan(cells, written(rejected, "unreadable"))


def rejected_files(files: DataFrame, with_rows: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Files without a reader, files that can't be read, and files without any row.

    ``with_rows`` has one row per file that has rows.
    """
    unknown = files.filter(F.col("reason").isNotNull()).select("file", "reason")
    empty = files.filter(F.col("reason").isNull()).join(with_rows.select("file"), "file", "left_anti")
    if unreadable is not None:
        unknown = unknown.unionByName(unreadable.select("file", "reason"))
        empty = empty.join(unreadable.select("file"), "file", "left_anti")
    return unknown.unionByName(empty.select("file", F.lit(NO_DATA).alias("reason")))


def output_columns(df: DataFrame) -> DataFrame:
    """Contract columns under their headers, in contract order, '' for missing."""
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.header) for f in CONTRACT])


class NothingToWrite(ValueError):
    pass


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def _quoted_line(df: DataFrame) -> tuple[str, Column]:
    header = ",".join('"' + f.header + '"' for f in CONTRACT)
    cells = [_quoted(F.coalesce(F.col(f.name), F.lit(""))) for f in CONTRACT]
    return header, F.concat_ws(",", *cells)


def write_contract_by_file(valid: DataFrame, path: str) -> None:
    """One output per input file, in row order, under ``data``, and a list of all outputs under ``manifest``.

    ``valid`` has ``file, row_idx`` and the fields.  A file's rows are dealt
    out in chunks of 2^20, each written by one task as one part with the
    header first, so that only a very large file is several parts.  All
    outputs become visible together, as :mod:`named` says.
    """
    if valid.isEmpty():
        raise NothingToWrite("No valid rows to export")
    header, line = _quoted_line(valid)
    content = F.concat(line, F.lit(LINE_END))
    pieces = valid.select(F.col("file").alias("name"), chunk_of(F.col("row_idx")).alias("part"), F.col("row_idx").alias("place"), content.alias("content"))
    named.write_named(pieces, path, header + LINE_END)


def write_contract(valid: DataFrame, path: str, single_file: bool = False) -> None:
    """Write every cell quoted, under a header, as comma-separated text.

    Refuses a table without rows.  Lines are made here and written as text,
    because the built-in writer changes line breaks inside cells to the line
    end it is given.  Every part starts with the header: the low bits of the
    row id are zero for the first row of a partition.  ``single_file`` is for
    small outputs: it sends all rows through one task.
    """
    if valid.isEmpty():
        raise NothingToWrite("No valid rows to export")
    out = output_columns(valid)
    if single_file:
        out = out.coalesce(1)
    header = ",".join('"' + h + '"' for h in out.columns)
    line = F.concat_ws(",", *[_quoted(F.col(f"`{h}`")) for h in out.columns])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    text = F.when(first, F.concat(F.lit(header + LINE_END), line)).otherwise(line)
    # A partition that were cut into several parts would have one header only.
    out.select(text.alias("value")).write.option("maxRecordsPerFile", 0).text(path, lineSep=LINE_END)


def read_contract(spark: SparkSession, path: str, by_file: bool = False) -> DataFrame:
    """Read back what :func:`write_contract` wrote, under field names, or what was written by file."""
    fields = [F.coalesce(F.col(f"`{f.header}`"), F.lit("")).alias(f.name) for f in BY_NAME.values()]
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=True, nullValue="\x00", emptyValue="")
    if not by_file:
        return reader.csv(path).select(*fields)
    outputs = named.manifest(spark, path).select(F.col("name").alias("file"), file_uri(F.col("output")).alias("output"))
    rows = reader.option("recursiveFileLookup", "true").csv(f"{path}/data").select(file_uri(F.col("_metadata.file_path")).alias("output"), *fields)
    return rows.join(written(outputs, "outputs"), "output").drop("output")
