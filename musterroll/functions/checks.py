"""Checks of one field: an array with the field's problem, or an empty one.

Arrays of at most one problem are joined with ``concat``, which is part of
generated code.  A filter over an array of nullable structs would be shorter,
but everything inside a lambda's argument is interpreted row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll import fixed_values as V
from musterroll.contract import Field
from musterroll.functions import dates, normal, text as X

PROBLEMS = "array<struct<field_pos:int,field:string,value:string,message:string,auto_fixable:boolean,suggested:string>>"


def matches(value: Column, pattern: str) -> Column:
    return value.rlike("(?i)" + X.whole(pattern))


def none() -> Column:
    return F.array().cast(PROBLEMS)


def _problem(field: Field, value: Column, message: str, suggested: Column | None = None) -> Column:
    fix = F.lit(None).cast("string") if suggested is None else suggested
    return F.array(
        F.struct(
            F.lit(field.pos).alias("field_pos"),
            F.lit(field.name).alias("field"),
            value.alias("value"),
            F.lit(message).alias("message"),
            F.lit(suggested is not None).alias("auto_fixable"),
            fix.alias("suggested"),
        )
    ).cast(PROBLEMS)


def _first(*cases: tuple[Column, Column | None]) -> Column:
    """The first case that holds; a case with None means 'no problem'."""
    out = None
    for cond, result in cases:
        result = none() if result is None else result
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out.otherwise(none())


def prepared(field: Field, v: Column) -> Column | None:
    """A form of the value that the field's rules look at several times."""
    if field.kind == "date":
        return F.when(v.rlike(dates.UK_SHAPE), dates.padded(v))
    if field.kind == "postcode":
        return normal.spaced_postcode(F.replace(F.upper(v), F.lit(" "), F.lit("")))
    if field.kind == "integer":
        return X.to_double(v)
    if field.kind == "phone":
        return F.regexp_replace(v, rf"[{X.BLANK}\-()+]", "")
    return None


def _email(field: Field, v: Column) -> list:
    return [(~matches(v, V.EMAIL_PATTERN), _problem(field, v, V.MSG_EMAIL))]


def _date(field: Field, v: Column, laid_out: Column, iso_dayfirst: bool, normalized: bool) -> list:
    """A normalised value that still has another shape is one that could not be read."""
    flipped = dates.swapped(laid_out)

    def converted(read: Column) -> Column:
        return F.when(read.isNotNull(), _problem(field, v, V.MSG_DATE_CONVERT, read)).otherwise(
            _problem(field, v, V.MSG_DATE_BAD)
        )

    other = _problem(field, v, V.MSG_DATE_BAD) if normalized else X.let(dates.read_date(v, iso_dayfirst), converted)
    return [
        (laid_out.isNull(), other),
        (dates.exists(laid_out), None),
        (dates.exists(flipped), _problem(field, v, V.MSG_DATE_US, flipped)),
        (F.lit(True), _problem(field, v, V.MSG_DATE_RANGE)),
    ]


def _postcode(field: Field, v: Column, laid_out: Column) -> list:
    good = (F.length(laid_out) > 5) & matches(laid_out, V.POSTCODE_PATTERN)
    return [
        (good & (laid_out == v), None),
        (good, _problem(field, v, V.MSG_POSTCODE_FORMAT, laid_out)),
        (~matches(v, V.POSTCODE_PATTERN), _problem(field, v, V.MSG_POSTCODE)),
    ]


def _integer(field: Field, v: Column, number: Column) -> list:
    # Limits apply to the whole part, which is cut towards zero.
    cases = [(number.isNull() | (F.abs(number) == F.lit(math.inf)), _problem(field, v, V.MSG_NUMBER))]
    if field.lowest is not None:
        low = field.lowest
        below = number < low if low > 0 else number <= low - 1
        cases.append((below, _problem(field, v, V.MSG_AT_LEAST.format(limit=low))))
    if field.highest is not None:
        high = field.highest
        above = number >= high + 1 if high >= 0 else number > high
        cases.append((above, _problem(field, v, V.MSG_AT_MOST.format(limit=high))))
    return cases


def _phone(field: Field, v: Column, digits: Column) -> list:
    return [
        (F.length(digits) < 10, _problem(field, v, V.MSG_PHONE_SHORT)),
        (~digits.rlike(r"^[0-9]+\z"), _problem(field, v, V.MSG_PHONE_CHARS)),
    ]


def _allowed(field: Field, v: Column) -> list:
    lowered = F.lower(v)
    cases = [(v.isin(*field.allowed), None)]
    if field.name == "gender":
        cases += [(lowered == word, _problem(field, v, V.MSG_GENDER, F.lit(full))) for word, full in V.GENDER_WORDS.items()]
    else:
        cases += [(lowered == word.lower(), _problem(field, v, V.MSG_CASE, F.lit(word))) for word in field.allowed]
    cases.append((F.lit(True), _problem(field, v, V.MSG_ALLOWED.format(allowed=", ".join(field.allowed)))))
    return cases


def check(field: Field, value: Column, form: Column | None, iso_dayfirst: bool = False, normalized: bool = False) -> Column:
    """Required first, then empties pass, then the rule of the field's kind.

    ``form`` is what :func:`prepared` gave for the value.
    """
    blank = value == ""
    missing = _problem(field, value, V.MSG_REQUIRED.format(label=field.label)) if field.required else None
    rules: list = []
    if field.kind == "email":
        rules = _email(field, value)
    elif field.kind == "date":
        rules = _date(field, value, form, iso_dayfirst, normalized)
    elif field.kind == "postcode":
        rules = _postcode(field, value, form)
    elif field.kind == "integer":
        rules = _integer(field, value, form)
    elif field.kind == "phone":
        rules = _phone(field, value, form)
    elif field.allowed:
        rules = _allowed(field, value)
    return _first((blank, missing), *rules)


def can_fail(field: Field) -> bool:
    return field.required or field.kind != "text" or bool(field.allowed)


def check_typed_date(field: Field, value: Column, col: Column, dtype: T.DataType) -> Column:
    """A date column that is not text: always convertible, unless empty."""
    read = normal.typed_date(col, dtype)
    return _first(
        (value == "", _problem(field, value, V.MSG_REQUIRED.format(label=field.label)) if field.required else None),
        (read.isNotNull(), _problem(field, value, V.MSG_DATE_CONVERT, read)),
        (F.lit(True), _problem(field, value, V.MSG_DATE_BAD)),
    )
