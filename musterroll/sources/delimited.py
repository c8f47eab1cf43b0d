"""Scan comma-separated files into ``file, row_idx, cells``.

Files are read once, as split text, so that one very large file is shared by
many tasks; the lines are written with the split that they came in, because
another read may cut the files elsewhere.  Two facts are worked out per split
and summed along the file: how many records it starts with, and whether it
begins inside a quoted cell.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from musterroll.runtime import file_uri, written

BOM = "\ufeff"

# Longer cells are not data but a quote that was never closed; readers of
# such files refuse them at this size.
LONGEST_CELL = 131_072
LONGEST_RECORD = 64 * LONGEST_CELL  # what is put together in one task at most

# Facts of splits are broadcast in parts of at most so many bytes, counted at
# so many for each; a task reads at most so many splits (the default of
# Spark's packing of small files).
BROADCAST_BYTES = 256 << 20
FACT_BYTES = 64
SPLITS_A_TASK = 32
NOT_TEXT = "Not UTF-8 text"
TOO_MUCH = f"A record has more than {LONGEST_RECORD} characters (unclosed quote?)"
TOO_LONG = f"A cell has more than {LONGEST_CELL} characters (unclosed quote?)"


class Scan(NamedTuple):
    cells: DataFrame  # file, row_idx, cells
    rejected: DataFrame  # file, reason

# One cell after a comma: quoted (with doubled quotes), or plain.  Possessive
# repeats keep the matcher from using the stack for long cells.
_CELL = r'(?s),("(?:[^"]++|"")*+(?:"[^,]*+)?|[^,]*+)'
_QUOTED = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'

# A line that ends inside a quoted cell, if it began outside one.
_OPENS = r'^(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+$'


def ends_inside(line: Column, began_inside: bool) -> Column:
    """Whether a quoted cell is still open at the end of the line."""
    text = F.concat(F.lit('"'), line) if began_inside else line
    return F.contains(line, F.lit('"')) & text.rlike(_OPENS) if not began_inside else text.rlike(_OPENS)


def split_cells(record: Column) -> Column:
    """Cells of one record; a blank line has none."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))

    def unquote(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, _QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(c.startswith('"'), F.concat(inner, F.regexp_extract(c, _QUOTED, 2))).otherwise(c)

    return (
        F.when(record == "", F.array().cast("array<string>"))
        .when(~record.contains('"'), F.split(record, ",", -1))
        .otherwise(F.transform(quoted, unquote))
    )


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """``file, split, key, line_id, line`` in scan order within a split; ``key`` is a hash of the first two."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    placed = lines.select(
        file_uri(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"),
    )
    return placed.select("file", "split", F.xxhash64("file", "split").alias("key"), "line_id", "line")


def parts_of(lines: DataFrame) -> int:
    """In how many parts the facts of a scan's splits can be broadcast, by what the scan may have at most."""
    most = lines.rdd.getNumPartitions() * SPLITS_A_TASK
    return max(1, -(-most * FACT_BYTES // BROADCAST_BYTES))


def split_facts(lines: DataFrame) -> DataFrame:
    """Per split: its first line, the lines before it, and whether its file has open quotes.

    Files are summed over their splits: a few hundred thousand small rows at
    most for a file of many terabytes.
    """
    per_split = lines.groupBy("file", "split").agg(
        F.min("line_id").alias("first_id"),
        F.count("*").alias("n_lines"),
        F.max(ends_inside(F.ltrim(F.col("line"), F.lit(BOM)), False)).alias("has_open"),
        F.max(~F.is_valid_utf8("line")).alias("not_text"),
        F.max(F.char_length("line")).alias("longest"),
    )
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    return per_split.select(
        "file",
        "split",
        "first_id",
        F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"),
        F.max("has_open").over(whole).alias("file_open"),
        F.max("not_text").over(whole).alias("not_text"),
        F.max("longest").over(whole).alias("longest"),
    )


def number_lines(lines: DataFrame, facts: DataFrame, parts: int = 1) -> DataFrame:
    """Position of every line in its file, counted from 0.

    Text is never shuffled: what a line needs of its split is three numbers,
    found by the split's key in a broadcast whose size ``parts`` bounds.  With
    more than one part, each is a table of its own, so that only one broadcast
    is held at a time.
    """
    numbers = facts.select(F.xxhash64("file", "split").alias("key"), "split", (F.col("lines_before") - F.col("first_id")).alias("ahead"), "file_open")

    def numbered(some: DataFrame, of: DataFrame) -> DataFrame:
        line_no = F.col("line_id") + F.col("ahead")
        clean = F.when(line_no == 0, F.ltrim(F.col("line"), F.lit(BOM))).otherwise(F.col("line"))
        # The estimate of the parts is checked against what there is.
        small = F.broadcast(of) if of.count() * FACT_BYTES <= 2 * BROADCAST_BYTES else of
        return some.join(small, ["key", "split"]).select("file", "split", line_no.alias("line_no"), clean.alias("line"), "file_open")

    if parts == 1:
        return numbered(lines, numbers)
    of_part = lambda table, p: table.filter(part_of(F.col("key"), parts) == p)
    each = [written(numbered(lines.filter(F.col("part") == p), of_part(numbers, p)), f"numbered-{p}") for p in range(parts)]
    return reduce(DataFrame.unionByName, each)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(key, F.lit(parts)).cast("int")


def place_quoted_lines(numbered: DataFrame) -> DataFrame:
    """Give every line the position of its record, where quoted cells hold line breaks.

    Each line maps "began inside a quoted cell" to "ends inside one": it
    always closes, always opens, keeps, or flips.  Within a split the state is
    known from the last line that sets it and the flips since then; across
    splits the same two facts are carried along the file.  Both windows work
    on one split (bounded by its bytes) or on one row per split.
    """
    a = ends_inside(F.col("line"), False)
    b = ends_inside(F.col("line"), True)
    lines = numbered.withColumns(
        {"sets": F.when(a == b, a), "flips": F.when(a & ~b, 1).otherwise(0)}
    )
    # State after a line, relative to the split's start.
    upto = Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum("flips").over(upto)
    lines = lines.withColumn("flips_upto", flips)
    lines = lines.withColumns(
        {
            "last_set": F.last("sets", True).over(upto),
            "flips_at_set": F.last(F.when(F.col("sets").isNotNull(), F.col("flips_upto")), True).over(upto),
        }
    )
    odd = lambda c: (c % 2) == 1
    per_split = lines.groupBy("file", "split").agg(F.max_by(F.struct("last_set", "flips_at_set", "flips_upto"), "line_no").alias("s"))
    chain = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per_split = per_split.select(
        "file",
        "split",
        F.sum("s.flips_upto").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.col("s.flips_upto").alias("own"),
        F.col("s.last_set").alias("own_set"),
        F.col("s.flips_at_set").alias("own_at"),
    )
    at = F.when(F.col("own_set").isNotNull(), F.struct(F.col("own_set").alias("v"), (F.col("run") - F.col("own") + F.col("own_at")).alias("at")))
    per_split = per_split.withColumn("at", at)
    seen = F.last("at", True).over(chain)
    flips_before = F.coalesce(F.sum("own").over(chain), F.lit(0))
    starts = per_split.select("file", "split", seen.alias("seen"), flips_before.alias("flips_before"))
    began = F.when(
        F.col("seen").isNull(), odd(F.col("flips_before"))
    ).otherwise(F.col("seen.v") != odd(F.col("flips_before") - F.col("seen.at")))
    starts = starts.select("file", "split", began.alias("split_inside"))

    state = F.when(F.col("last_set").isNotNull(), F.col("last_set") != odd(F.col("flips_upto") - F.col("flips_at_set"))).otherwise(
        F.col("split_inside") != odd(F.col("flips_upto"))
    )
    placed = lines.join(starts, ["file", "split"]).withColumn("inside_after", state)
    in_split = Window.partitionBy("file", "split").orderBy("line_no")
    inside = F.coalesce(F.lag("inside_after").over(in_split), F.col("split_inside"))
    placed = placed.withColumn("starts", F.when(inside, 0).otherwise(1))
    count = F.sum("starts").over(upto)
    heads = placed.groupBy("file", "split").agg(F.sum("starts").alias("n_heads"))
    heads = heads.select("file", "split", F.coalesce(F.sum("n_heads").over(chain), F.lit(0)).alias("heads_before"))
    numbered = placed.withColumn("count", count).join(heads, ["file", "split"])
    record_no = F.col("heads_before") + F.col("count") - 1
    return numbered.select("file", record_no.alias("row_idx"), "line_no", "line")


def joined_records(pieces: DataFrame) -> DataFrame:
    """Records from their lines, which must be known to be short enough."""
    joined = pieces.groupBy("file", "row_idx").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return joined.select("file", "row_idx", F.array_join(F.transform("ls", lambda x: x.line), "\n").alias("record"))


def read_delimited(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> Scan:
    """Every record of every file under ``path``, and the files that can't be read.

    Files without line breaks inside quotes (found in the first pass) are not
    shuffled; only the others go through the quoted-line windows.  A file that
    is not UTF-8, or that has a cell too long to be one, is rejected whole.
    """
    read = read_lines(spark, path, glob)
    parts = parts_of(read)
    if parts > 1:
        lines = written(read.withColumn("part", part_of(F.col("key"), parts)), "lines", ["part"])
    else:
        lines = written(read, "lines")
    facts = written(split_facts(lines), "split-facts")
    rejected = facts.filter("not_text").select("file", F.lit(NOT_TEXT).alias("reason")).distinct()
    numbered = number_lines(lines, facts.filter(~F.col("not_text")), parts)
    records = numbered.filter(~F.col("file_open")).select("file", F.col("line_no").alias("row_idx"), F.col("line").alias("record"))
    shape = facts.agg(F.max("file_open").alias("quoted"), F.max("longest").alias("longest")).first()
    if shape.quoted:
        pieces = written(place_quoted_lines(numbered.filter("file_open")), "quoted-lines")
        sizes = pieces.groupBy("file", "row_idx").agg(F.sum(F.char_length("line") + 1).alias("size"))
        endless = written(sizes.filter(F.col("size") > LONGEST_RECORD).select("file").distinct(), "endless")
        records = records.unionByName(joined_records(pieces.join(endless, "file", "left_anti")))
        rejected = rejected.unionByName(endless.select("file", F.lit(TOO_MUCH).alias("reason")))
    cells = records.select("file", "row_idx", split_cells(F.col("record")).alias("cells"))
    if shape.quoted or (shape.longest or 0) > LONGEST_CELL:
        long = records.filter(F.char_length("record") > LONGEST_CELL).select("file", split_cells(F.col("record")).alias("cells"))
        over = long.filter(F.exists("cells", lambda c: F.char_length(c) > LONGEST_CELL)).select("file").distinct()
        over = written(over, "long-cells")
        cells = cells.join(over, "file", "left_anti")
        rejected = rejected.unionByName(over.select("file", F.lit(TOO_LONG).alias("reason")))
    return Scan(cells, rejected)


def scan_delimited(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """``file, row_idx, cells`` of the files that can be read."""
    return read_delimited(spark, path, glob).cells
