"""Find the header row and the last data row of every file.

Input is ``cells``: ``file, row_idx, cells``.  All rules are expressions over
one row; a single aggregation per file, combined before the shuffle, turns
them into bounds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll import fixed_values as V
from musterroll.contract import CONTRACT
from musterroll.functions import text as X
from musterroll.runtime import with_file_facts

HEAD_ROWS = 20
PREVIEW = 5

_LABELS = [f.label.lower() for f in CONTRACT]
_EXPECTED = sorted({h for f in CONTRACT for h in (f.header.lower(), f.label.lower())})
_SEP = "\x00"


def texts(cells: Column) -> Column:
    return F.transform(cells, lambda c: X.strip(F.coalesce(c, F.lit(""))))


def is_empty_row(cells: Column) -> Column:
    return F.forall(cells, lambda c: X.strip(F.coalesce(c, F.lit(""))) == "")


def header_score(cells: Column) -> Column:
    """Number of cells that equal, contain or are part of an expected header.

    "Part of some header" is one search in all headers joined; "contains some
    header" is one alternation.  Parts shorter than three characters count
    only when equal.
    """
    joined = _SEP.join(_EXPECTED)
    any_label = "|".join(re.escape(h) for h in _LABELS)
    shortest = min(len(h) for h in _LABELS)

    def hit(raw: Column) -> Column:
        c = F.lower(X.strip(F.coalesce(raw, F.lit(""))))
        size = F.length(c)
        return c.isin(*[h for h in _EXPECTED if len(h) < 3]) | (
            (size >= 3) & (F.lit(joined).contains(c) | ((size >= shortest) & c.rlike(any_label)))
        )

    return F.size(F.filter(cells, hit))


def looks_like_header(cells: Column) -> Column:
    """At least three filled cells, mostly words with capitals or blanks."""
    filled = F.filter(texts(cells), lambda c: c != "")

    def wordy(c: Column) -> Column:
        number = X.reads_as_float(X.strip(F.replace(c, F.lit(","), F.lit(""))))
        date = c.rlike(r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\z")
        return ~number & ~date & (F.length(c) > 2) & (X.is_title(c) | X.is_upper(c) | c.contains(" "))

    n = F.size(filled)
    words = F.size(F.filter(F.slice(filled, 1, 10), wordy))
    return (n >= 3) & (words >= F.least(F.lit(3.0), n * 0.5))


def has_summary_word(cells: Column, match: str = "substring") -> Column:
    """A footer word anywhere in the row's text; ``match='word'`` wants whole words."""
    words = "|".join(re.escape(w) for w in V.SUMMARY_WORDS)
    pattern = {"substring": words, "word": rf"\b(?:{words})\b"}[match]
    return F.lower(F.array_join(texts(cells), " ")).rlike(pattern)


def is_likely_data(cells: Column, match: str = "substring") -> Column:
    """Enough filled cells, no footer word, not just numbers."""
    filled = F.filter(texts(cells), lambda c: c != "")
    n = F.size(filled)
    money = lambda c: X.reads_as_float(X.strip(F.translate(c, ",£$", "")))
    all_numbers = F.forall(F.slice(filled, 1, 5), money)
    namelike = lambda c: c.rlike("[a-zA-Z]{2,}") & ~c.rlike("^[0-9]+[/-][0-9]+")
    only_numbers = (n >= 5) & all_numbers & ~F.exists(filled, namelike)
    return (F.size(cells) > 0) & (n >= F.size(cells) * 0.3) & ~has_summary_word(cells, match) & ~only_numbers


def detect_range(cells: DataFrame, min_matches: int = V.MIN_HEADER_MATCHES, match: str = "substring") -> DataFrame:
    """``file, header_idx, last_idx, end_idx`` with one row per file.

    The last data row is the last row of the file that looks like data: blank
    rows do not, so walking up over both kinds is the same as one maximum.
    """
    c, i = F.col("cells"), F.col("row_idx")
    found = cells.groupBy("file").agg(
        F.min(F.when(header_score(c) >= min_matches, i)).alias("named_idx"),
        F.min(F.when((i < HEAD_ROWS) & looks_like_header(c), i)).alias("wordy_idx"),
        F.max(F.when(is_likely_data(c, match), i)).alias("likely_idx"),
        F.max(i).alias("end_idx"),
    )
    zero = F.lit(0).cast("long")
    header = F.coalesce("named_idx", "wordy_idx", zero)
    return found.select(
        "file",
        header.alias("header_idx"),
        F.greatest(F.coalesce("likely_idx", header), header).alias("last_idx"),
        "end_idx",
    )


def override_range(bounds: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Replace detected bounds by given ones (``file, header_idx, last_idx``)."""
    if overrides is None:
        return bounds
    given = overrides.select("file", F.col("header_idx").alias("_h"), F.col("last_idx").alias("_l"))
    return bounds.join(given, "file", "left").select(
        "file",
        F.coalesce("_h", "header_idx").alias("header_idx"),
        F.when(F.col("_h").isNotNull(), F.coalesce("_l", "end_idx")).otherwise(F.col("last_idx")).alias("last_idx"),
        "end_idx",
    )


def trim_rows(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Data rows only, numbered from the header in ``data_idx``."""
    joined = with_file_facts(cells, bounds, "end_idx")
    inside = (F.col("row_idx") > F.col("header_idx")) & (F.col("row_idx") <= F.col("last_idx"))
    return joined.filter(inside).select(
        *cells.columns, (F.col("row_idx") - F.col("header_idx") - 1).alias("data_idx")
    )


def removed_rows(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows above the header and below the last data row, whole, with the side they were cut from."""
    i = F.col("row_idx")
    joined = with_file_facts(cells, bounds.select("file", "header_idx", "last_idx", "end_idx"), "end_idx")
    side = F.when(i < F.col("header_idx"), "top").when(i > F.col("last_idx"), "bottom")
    reason = F.when(has_summary_word(F.col("cells")), "footer word").when(is_empty_row(F.col("cells")), "empty").otherwise("outside the data")
    return joined.withColumn("side", side).filter(F.col("side").isNotNull()).select("file", "row_idx", "side", "cells", reason.alias("reason"))


def header_rows(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """The header row of each file."""
    return with_file_facts(cells, bounds, "end_idx").filter(F.col("row_idx") == F.col("header_idx")).select("file", "cells")


def trim_counts(bounds: DataFrame) -> DataFrame:
    return bounds.select(
        "file",
        F.col("header_idx").alias("cut_top"),
        (F.col("end_idx") - F.col("last_idx")).alias("cut_bottom"),
        (F.col("last_idx") - F.col("header_idx") + 1).alias("kept"),
    )


def trim_preview(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """First rows cut at the top and last rows cut at the bottom.

    Row numbers have no gaps, so both ends are plain comparisons.
    """
    i = F.col("row_idx")
    top = i < F.least(F.col("header_idx"), F.lit(PREVIEW))
    bottom = i >= F.greatest(F.col("last_idx") + 1, F.col("end_idx") + 1 - PREVIEW)
    shown = F.filter(F.slice("cells", 1, 5), lambda c: c != "")
    line = F.array_join(F.transform(shown, lambda c: F.left(c, F.lit(20))), " | ")
    short = F.when(F.length(line) > 70, F.concat(F.left(line, F.lit(67)), F.lit("..."))).otherwise(line)
    return (
        with_file_facts(cells, bounds, "end_idx")
        .filter(top | bottom)
        .select("file", F.when(top, "top").otherwise("bottom").alias("side"), (i + 1).alias("row_no"), short.alias("preview"))
    )
