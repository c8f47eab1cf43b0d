"""Check all contract fields of a wide table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.contract import CONTRACT
from musterroll.functions import checks, normal, text as X
from musterroll.operators.normalize import with_all_fields
from musterroll.runtime import one_row_each


def _checked(df: DataFrame, skip_fields: Iterable[str], iso_dayfirst: bool, into: str, normalized: bool = False, where: Column | None = None) -> DataFrame:
    """Add the row's problems in contract order, at most one per field.

    Rows outside ``where`` are not looked at and get null.

    Stripped text is a projection of its own, so that it is made once per
    field.  Fields in ``skip_fields`` are left out of the expression: their
    rules are never run.
    """
    skip = set(skip_fields)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    todo = [f for f in CONTRACT if f.name not in skip and checks.can_fail(f)]
    texts = {} if normalized else {f"_v_{f.name}": X.as_text(F.col(f.name), kinds[f.name]) for f in todo}
    text = lambda f: F.col(f.name if normalized else f"_v_{f.name}")
    forms = {f"_w_{f.name}": checks.prepared(f, text(f)) for f in todo}
    forms = {n: c for n, c in forms.items() if c is not None}

    def one(field) -> Column:
        col, dtype, value = F.col(field.name), kinds[field.name], text(field)
        if field.kind == "date" and normal.typed_date(col, dtype) is not None:
            return checks.check_typed_date(field, value, col, dtype)
        form = F.col(f"_w_{field.name}") if f"_w_{field.name}" in forms else None
        return checks.check(field, value, form, iso_dayfirst, normalized)

    found = F.concat(checks.none(), *[one(f) for f in todo])
    if where is not None:
        texts, forms = ({n: F.when(where, c) for n, c in some.items()} for some in (texts, forms))
        found = F.when(where, found)
    staged = df.withColumns(texts) if texts else df
    return staged.withColumns(forms).withColumn(into, found).drop(*texts, *forms)


def validate_table(
    df: DataFrame, skip_fields: Iterable[str] = (), iso_dayfirst: bool = False, normalized: bool = False
) -> DataFrame:
    """Add ``errors``; narrow projections only.

    ``normalized`` says that the table comes from ``normalize_table``, whose
    values are text without blanks at the ends, so none are cut again.
    """
    return _checked(with_all_fields(df), skip_fields, iso_dayfirst, "errors", normalized)


def revalidate_where(df: DataFrame, cond: Column, skip_fields: Iterable[str] = (), iso_dayfirst: bool = False) -> DataFrame:
    """Check rows again where ``cond`` holds; other rows keep their errors.

    Values are checked as they are, not normalised first.
    """
    again = _checked(df, skip_fields, iso_dayfirst, "_again", where=cond)
    return again.withColumn("errors", F.when(cond, F.col("_again")).otherwise(F.col("errors"))).drop("_again")


def with_row_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_valid": F.size("errors") == 0,
            "has_auto_fixable": F.exists("errors", lambda e: e.auto_fixable),
            "has_manual": F.exists("errors", lambda e: ~e.auto_fixable),
        }
    )


def row_label() -> Column:
    """First name and surname, or the row number where both are empty."""
    name = F.trim(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("surname", F.lit(""))))
    number = F.concat(F.lit("Row "), (F.col("row_idx") + 1).cast("string"))
    return F.when(name == "", number).otherwise(name)


def error_table(df: DataFrame) -> DataFrame:
    """One row per problem."""
    return one_row_each(df, ["file", "row_idx"], "errors", "e").select("file", "row_idx", "e.*")
