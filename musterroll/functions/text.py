"""Text helpers as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as blank at the ends of a cell.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u1680\u2028\u2029\u202f\u205f\u3000"
)

# Decimal text: sign, digits (single underscores between them), point, exponent.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
NOT_FINITE = r"(?i)^[+-]?(?:nan|inf|infinity)\z"

# A blank of any kind inside a pattern.
BLANK = r"\p{IsWhite_Space}"

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def whole(pattern: str) -> str:
    """A shared pattern as this engine needs it.

    Here ``$`` also matches before a last line end, and ``\\s`` knows ASCII
    blanks only; spreadsheets export others.
    """
    ended = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern
    return ended.replace(r"\s", BLANK)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Keeps long rules small: without it the text of ``value`` is repeated at
    every use, and the generated Java method outgrows the 64 KB limit.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Remove blanks of every kind from both ends.

    Most cells have printable ASCII at both ends, which two characters show;
    only the others pay for the search in a set of characters.
    """
    plain = F.ascii(col).between(33, 126) & F.ascii(F.substring(col, -1, 1)).between(33, 126)
    return F.when((col == "") | plain, col).otherwise(F.trim(col, F.lit(BLANKS)))


def as_text(col: Column, dtype: T.DataType) -> Column:
    """Any input column as stripped text; missing values become ''."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = col.try_cast("bigint")
        col = (
            F.when(F.isnan(col), F.lit(""))
            .when(whole.cast("double") == col.cast("double"), whole.cast("string"))
            .otherwise(col.cast("string"))
        )
    elif not isinstance(dtype, T.StringType):
        col = col.cast("string")
    return strip(F.coalesce(col, F.lit("")))


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def reads_as_float(text: Column) -> Column:
    """True where the text is a number, or names infinity or not-a-number."""
    return text.rlike(NUMBER) | text.rlike(NOT_FINITE)


def to_double(text: Column) -> Column:
    """The number in the text, or null where there is none."""
    return F.when(is_number(text), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def is_single_case(text: Column) -> Column:
    """Has letters with case, all lower or all upper."""
    lower, upper = F.lower(text), F.upper(text)
    return (lower != upper) & ((text == lower) | (text == upper))


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    """Every run of letters starts upper and goes on lower."""
    return (
        text.rlike(rf"[{_CASED}]")
        & ~text.rlike(rf"(?:^|[^{_CASED}])\p{{Ll}}")
        & ~text.rlike(rf"[{_CASED}][\p{{Lu}}\p{{Lt}}]")
    )


def title(text: Column) -> Column:
    """Capitalise every run of letters (``O'BRIEN`` gives ``O'Brien``).

    ``initcap`` breaks words at blanks only, so it is used where that is
    enough, and run by run elsewhere.
    """
    runs = F.regexp_extract_all(text, F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    by_run = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(text.rlike(r"^[A-Za-z]+\z"), F.initcap(text)).otherwise(by_run)
