"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The blanks of every contract, and a word as a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other letter stays as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text is an empty one."""
    return F.coalesce(text, F.lit("")).cast("binary")


def term_table(digits: bool) -> bytes:
    """For ``bytes.translate`` over UTF-8: A-Z in lower case, and a space for every ASCII character that no term holds.

    Terms are made of ASCII letters, of digits where ``digits`` says so, and
    of all characters beyond ASCII.
    """
    plain = bytes(range(128)).decode()
    kept = "".join(c.lower() if c.isalpha() or (digits and c.isdigit()) else " " for c in plain)
    return kept.encode() + bytes(range(128, 256))
