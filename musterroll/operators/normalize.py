"""Normalise all contract fields of a wide table, with a log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.contract import CONTRACT, NAMES
from musterroll.functions import normal, text as X

CHANGE = "array<struct<field_pos:int,field:string,original:string,corrected:string,type:string>>"


def with_all_fields(df: DataFrame) -> DataFrame:
    """Add contract fields the table lacks, as nulls."""
    missing = {n: F.lit(None).cast("string") for n in NAMES if n not in df.columns}
    return df.withColumns(missing) if missing else df


def normalize_table(df: DataFrame, iso_dayfirst: bool = False) -> DataFrame:
    """Replace the contract fields by their normal form and add ``changes``.

    Columns outside the contract (``file``, ``row_idx``, ...) pass through.
    One narrow projection: no shuffle, no Python.  ``changes`` costs nothing
    where it is not selected.
    """
    df = with_all_fields(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keep = [c for c in df.columns if c not in NAMES]

    texts = [X.as_text(F.col(f.name), kinds[f.name]).alias(f"_text_{f.name}") for f in CONTRACT]
    typed = [f for f in CONTRACT if f.kind == "date" and normal.typed_date(F.col(f.name), kinds[f.name]) is not None]
    typed_cols = [normal.typed_date(F.col(f.name), kinds[f.name]).alias(f"_typed_{f.name}") for f in typed]
    stripped = df.select(*keep, *texts, *typed_cols)

    def form(field) -> Column:
        value = F.col(f"_text_{field.name}")
        out = normal.normal_form(field, value, iso_dayfirst)
        if field in typed:
            out = F.coalesce(F.col(f"_typed_{field.name}"), out)
        return out.alias(field.name)

    formed = stripped.select(*keep, *[f"_text_{n}" for n in NAMES], *[form(f) for f in CONTRACT])

    def change(field) -> Column:
        before, after = F.col(f"_text_{field.name}"), F.col(field.name)
        entry = F.struct(
            F.lit(field.pos).alias("field_pos"),
            F.lit(field.label).alias("field"),
            before.alias("original"),
            after.alias("corrected"),
            F.lit("normalization").alias("type"),
        )
        changed = (before != "") & (before != after)
        return F.when(changed, F.array(entry).cast(CHANGE)).otherwise(F.array().cast(CHANGE))

    changes = F.concat(*[change(f) for f in CONTRACT])
    return formed.select(*keep, *NAMES, changes.alias("changes"))


def fill_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Put a constant where a field is empty."""
    blank = lambda n: X.strip(F.coalesce(F.col(n), F.lit(""))) == ""
    return df.withColumns({n: F.when(blank(n), F.lit(v)).otherwise(F.col(n)) for n, v in defaults.items()})
