"""Rows with too many or too few cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll import fixed_values as V
from musterroll.contract import ADDRESS_POS, DATE_POS, MEDICAL_POS, WIDTH
from musterroll.functions import dates, text as X

KEY = ["file", "row_idx"]


def looks_like_address(value: Column) -> Column:
    """Blank, or one of the known address shapes."""
    v = F.lower(X.strip(value))
    hit = v == ""
    for pattern in V.ADDRESS_PATTERNS:
        hit = hit | v.rlike("(?i)" + X.whole(pattern))
    return hit


def looks_like_date(value: Column) -> Column:
    v = X.strip(value)
    return (v == "") | v.rlike(dates.UK_SHAPE) | dates.read_date(v).isNotNull()


def check_width(df: DataFrame, expected: Column | int = WIDTH) -> DataFrame:
    """Add ``expected_n``, ``actual_n`` and ``extra_n``."""
    want = F.lit(expected) if isinstance(expected, int) else expected
    return df.withColumns({"expected_n": want.cast("int"), "actual_n": F.size("cells")}).withColumn(
        "extra_n", F.col("actual_n") - F.col("expected_n")
    )


def suggested_merge(medical_pos: Column) -> Column:
    """The cells that belong together, joined as text."""
    return F.array_join(F.slice("cells", medical_pos + 1, F.col("extra_n") + 1), ", ")


def _rebuilt(medical_pos: Column, merged_text: Column) -> Column:
    size = F.size("cells")
    return F.concat(
        F.slice("cells", F.lit(1), medical_pos),
        F.array(merged_text),
        F.slice("cells", medical_pos + F.col("extra_n") + 2, size),
    )


def repair(
    df: DataFrame,
    expected: Column | int = WIDTH,
    guard: str = "shape",
    medical_patches: DataFrame | None = None,
    medical_pos: Column | None = None,
    date_pos: Column | None = None,
    address_pos: Column | None = None,
) -> DataFrame:
    """Join medical cells that unquoted commas have split.

    ``guard='shape'`` accepts a merge when the date cell then holds a date and
    the address cell an address (or nothing).  ``'parity'`` looks for an
    address in the cell right after the medical one.  A row of
    ``medical_patches`` (``file, row_idx, text``) gives the text for a row
    that is too wide, without a guard; texts that differ for one row are none.

    Adds ``repaired`` (the new cells or null), ``repaired_by``, ``reason`` for
    rows left over, and ``suggestion``.
    """
    if guard not in ("shape", "parity"):
        raise ValueError(f"unknown guard: {guard}")
    med = (F.lit(MEDICAL_POS) if medical_pos is None else medical_pos).cast("int")
    day = F.lit(DATE_POS) if date_pos is None else date_pos
    adr = F.lit(ADDRESS_POS) if address_pos is None else address_pos

    df = check_width(df, expected)
    if medical_patches is not None:
        agreed = F.when(F.min("text") == F.max("text"), F.max("text"))
        given = medical_patches.groupBy(*KEY).agg(agreed.alias("_given"))
        df = df.join(given, KEY, "left")
    else:
        df = df.withColumn("_given", F.lit(None).cast("string"))

    wide = (F.col("extra_n") > 0) & med.isNotNull() & (med + F.col("extra_n") + 1 <= F.size("cells"))
    by_hand = wide & F.col("_given").isNotNull()

    def verdict(merged: Column) -> Column:
        cell = lambda pos: F.coalesce(F.get(merged, pos), F.lit(""))
        safe = looks_like_address(cell(med + 1))
        if guard == "shape":
            safe = looks_like_date(cell(day)) & looks_like_address(cell(adr))
        automatic = merged.isNotNull() & (F.size(merged) == F.col("expected_n")) & safe
        return F.struct(
            F.when(automatic, merged).when(by_hand, _rebuilt(med, F.col("_given"))).alias("repaired"),
            F.when(automatic, "guard").when(by_hand, "patch").alias("repaired_by"),
            F.when(F.col("extra_n") < 0, "too_few")
            .when((F.col("extra_n") > 0) & ~automatic & ~by_hand, "unsafe_merge")
            .alias("reason"),
        )

    merged = F.when(wide, _rebuilt(med, suggested_merge(med)))
    judged = df.withColumn("_r", F.when(F.col("extra_n") != 0, X.let(merged, verdict)))
    return judged.select(
        *[c for c in df.columns if c != "_given"],
        F.col("_r.repaired").alias("repaired"),
        F.col("_r.repaired_by").alias("repaired_by"),
        F.col("_r.reason").alias("reason"),
        F.when(wide, suggested_merge(med)).alias("suggestion"),
    )


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """Rows of the right width, with repairs in place."""
    return repaired.filter(F.col("reason").isNull()).withColumn("cells", F.coalesce("repaired", "cells"))


def width_quarantine(repaired: DataFrame) -> DataFrame:
    return repaired.filter(F.col("reason").isNotNull())


def repair_count(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy("file").agg(F.count_if(F.col("repaired_by").isNotNull()).alias("comma_repairs"))
