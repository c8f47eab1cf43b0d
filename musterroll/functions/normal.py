"""Normal form of one field, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll import fixed_values as V
from musterroll.contract import Field
from musterroll.functions import dates, text as X

def name_case(value: Column) -> Column:
    return F.when(X.is_single_case(value), X.title(value)).otherwise(value)


def enum_case(value: Column, allowed: tuple[str, ...]) -> Column:
    """Spell an allowed value as the contract does."""
    lowered = F.lower(value)
    out = None
    for word in allowed:
        hit = lowered == word.lower()
        out = F.when(hit, F.lit(word)) if out is None else out.when(hit, F.lit(word))
    return out.otherwise(value)


def email(value: Column) -> Column:
    return F.lower(value)


def postcode(value: Column) -> Column:
    return spaced_postcode(F.regexp_replace(F.upper(value), f"{X.BLANK}+", ""))


def spaced_postcode(tight: Column) -> Column:
    """Put a blank before the last three of five or more characters."""
    return F.regexp_replace(tight, r"(?s)^(.{2,})(.{3})\z", "$1 $2")


def date(value: Column, iso_dayfirst: bool = False) -> Column:
    return F.when(value.rlike(dates.UK_PADDED), value).otherwise(
        F.coalesce(dates.read_date(value, iso_dayfirst), value)
    )


def integer(value: Column) -> Column:
    """Whole part of a number, read as a double, as text; other text is kept.

    Numbers of 38 digits and more, and infinite ones, are kept as they are.
    The first case is a shortcut: doubles hold fifteen digits exactly.
    """
    short = value.rlike(r"^[1-9][0-9]{0,14}\z")
    return F.when(short, value).otherwise(F.coalesce(X.let(X.to_double(value), _whole_part), value))


def _whole_part(number: Column) -> Column:
    """All digits of a double's whole part; above 2^63 in two exact halves."""
    unit = float(1 << 60)
    high = F.floor(F.abs(number) / unit)
    low = F.abs(number) - high * F.lit(unit)
    digits = high.cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + low.cast("bigint").cast("decimal(19,0)")
    shown = F.concat(F.when(number < 0, "-").otherwise(""), digits.cast("string"))
    return F.when(F.abs(number) < float(1 << 62), number.cast("bigint").cast("string")).when(F.abs(number) < 1e37, shown)


def typed_date(col: Column, dtype: T.DataType) -> Column | None:
    """Text for a date column that is not text itself; None if it is."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return dates.from_day(col)
    if isinstance(dtype, T.NumericType):
        return dates.from_serial(col)
    return None


def normal_form(field: Field, value: Column, iso_dayfirst: bool = False) -> Column:
    """Normal form of stripped, non-null text."""
    if field.kind == "email":
        return email(value)
    if field.kind == "postcode":
        return postcode(value)
    if field.kind == "date":
        return date(value, iso_dayfirst)
    if field.kind == "integer":
        return integer(value)
    if field.allowed:
        return enum_case(value, field.allowed)
    if field.name in V.NAME_CASE_FIELDS:
        return name_case(value)
    return value
