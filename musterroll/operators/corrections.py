"""Apply suggested fixes, human patches, skips and overrides.

Human answers are tables keyed by ``file`` and ``row_idx``; no step waits for
a person.  The keys are single rows, so these joins cannot be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll import fixed_values as V
from musterroll.contract import CONTRACT, NAMES
from musterroll.functions import checks, normal, text as X
from musterroll.operators.normalize import CHANGE
from musterroll.operators.validate import revalidate_where

KEY = ["file", "row_idx"]
PATCH_NOTE = "manual"


def fix_type(field: Column, message: Column) -> Column:
    """Class of a suggested fix."""
    kind_is = lambda kind: field.isin(*[f.name for f in CONTRACT if f.kind == kind])
    return (
        F.when(kind_is("date"), F.when(message.contains("US date"), "us_to_uk_date").otherwise("date_format"))
        .when(kind_is("postcode"), F.lit("postcode_format"))
        .when((field == "gender") & F.lower(message).contains("abbreviation"), F.lit("gender_abbreviation"))
        .when((field == "gender") | F.lower(message).contains("case"), F.lit("case_normalization"))
        .otherwise(F.lit("format"))
    )


def label_of(field: Column) -> Column:
    pairs = [x for f in CONTRACT for x in (F.lit(f.name), F.lit(f.label))]
    return F.element_at(F.create_map(*pairs), field)


def with_decisions(df: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Attach accepted and refused fields of each row (at most twenty each)."""
    if decisions is None:
        empty = F.array().cast("array<string>")
        return df.withColumns({"accepted": empty, "refused": empty})
    per_row = decisions.groupBy(*KEY).agg(
        F.collect_set(F.when(F.col("accept"), F.col("field"))).alias("accepted"),
        F.collect_set(F.when(~F.col("accept"), F.col("field"))).alias("refused"),
    )
    empty = F.array().cast("array<string>")
    return df.join(per_row, KEY, "left").withColumns(
        {"accepted": F.coalesce("accepted", empty), "refused": F.coalesce("refused", empty)}
    )


def apply_fixes(df: DataFrame, policy: str = "accept", decisions: DataFrame | None = None) -> DataFrame:
    """Write suggested values into their fields.

    ``policy='accept'`` takes every suggestion that ``decisions`` does not
    refuse; ``'review'`` takes only those it accepts.  Adds ``fixes``; what is
    not fixed stays in ``errors``.
    """
    if policy not in ("accept", "review"):
        raise ValueError(f"unknown fix policy: {policy}")
    df = with_decisions(df, decisions)

    def taken(e: Column) -> Column:
        wanted = ~F.array_contains("refused", e.field) if policy == "accept" else F.array_contains("accepted", e.field)
        return e.auto_fixable & e.suggested.isNotNull() & (e.suggested != "") & wanted

    fixes = F.transform(
        F.filter("errors", taken),
        lambda e: F.struct(
            e.field_pos.alias("field_pos"),
            label_of(e.field).alias("field"),
            e.value.alias("original"),
            e.suggested.alias("corrected"),
            fix_type(e.field, e.message).alias("type"),
        ),
    ).cast(CHANGE)

    # A field has one problem at most, so what is taken is a map, made once and only where there is any.
    entries = F.transform(F.filter("errors", taken), lambda e: F.struct(e.field, e.suggested))
    df = df.withColumn("_taken", F.when(F.exists("errors", lambda e: e.auto_fixable), F.map_from_entries(entries)))

    def fixed(field) -> Column:
        return F.coalesce(F.try_element_at("_taken", F.lit(field.name)), F.col(field.name)).alias(field.name)

    names = {f.name: fixed(f) for f in CONTRACT if f.can_suggest}
    passed = [c for c in df.columns if c not in ("errors", "accepted", "refused", "_taken")]
    return df.select(
        *[names.get(c, F.col(c)) for c in passed],
        F.filter("errors", lambda e: ~taken(e)).alias("errors"),
        fixes.alias("fixes"),
    )


def patch_conflicts(patches: DataFrame) -> DataFrame:
    """Cells for which people gave different values, with all of them."""
    several = patches.groupBy(*KEY, "field").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return several.filter(F.size("values") > 1)


def _agreed(value: Column) -> Column:
    """The one value of a group, or null where there are several."""
    return F.when(F.min(value) == F.max(value), F.max(value))


def apply_patches(df: DataFrame, patches: DataFrame | None, revalidate: bool = False, skip_fields=(), iso_dayfirst: bool = False) -> DataFrame:
    """Answer open errors with values supplied by people.

    A patch counts only for a field with an open error, and only where all
    patches of the cell agree (:func:`patch_conflicts` lists the others).
    Patched values are taken as they are, unless ``revalidate`` checks the
    patched row again.  Adds ``patched``.

    Only rows with open errors meet the patches; the others pass by.
    """
    if patches is None:
        return df.withColumn("patched", F.array().cast(CHANGE))
    per_row = patches.groupBy(*KEY).agg(
        *[_agreed(F.when(F.col("field") == n, F.col("value"))).alias(f"_patch_{n}") for n in NAMES]
    )
    is_open = F.size("errors") > 0
    settled = df.filter(~is_open).withColumn("patched", F.array().cast(CHANGE))
    joined = df.filter(is_open).join(per_row, KEY, "left")

    answers = F.create_map(*[x for n in NAMES for x in (F.lit(n), F.col(f"_patch_{n}"))])
    joined = joined.withColumn("_answers", F.map_filter(answers, lambda _, v: v.isNotNull()))
    answered = lambda e: F.map_contains_key("_answers", e.field)

    patched = F.transform(
        F.filter("errors", answered),
        lambda e: F.struct(
            e.field_pos.alias("field_pos"),
            label_of(e.field).alias("field"),
            e.value.alias("original"),
            F.element_at("_answers", e.field).alias("corrected"),
            F.lit(PATCH_NOTE).alias("type"),
        ),
    ).cast(CHANGE)

    def value(name: str) -> Column:
        patch = F.col(f"_patch_{name}")
        is_open = F.exists("errors", lambda e: e.field == name)
        return F.when(patch.isNotNull() & is_open, patch).otherwise(F.col(name)).alias(name)

    passed = [c for c in df.columns if c != "errors"]
    out = joined.select(
        *[value(c) if c in NAMES else F.col(c) for c in passed],
        F.filter("errors", lambda e: ~answered(e)).alias("errors"),
        patched.alias("patched"),
    )
    if revalidate:
        out = revalidate_where(out, F.size("patched") > 0, skip_fields, iso_dayfirst)
    return out.unionByName(settled)


def drop_skipped(df: DataFrame, skips: DataFrame | None) -> DataFrame:
    """Remove exactly the rows that people chose to leave out."""
    return df if skips is None else df.join(skips.select(*KEY), KEY, "left_anti")


def apply_overrides(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Force constants into every row."""
    return df.withColumns({n: F.lit(v) for n, v in overrides.items() if v})


def checked_overrides(config: DataFrame) -> DataFrame:
    """Normalise and check override settings, one row per owner.

    ``postcode`` and ``email`` become null where they are empty or bad;
    ``postcode_ok`` and ``email_ok`` are false only for bad values.
    """
    code = F.upper(X.strip(F.coalesce("postcode", F.lit(""))))
    code = F.when(code.contains(" "), code).otherwise(normal.spaced_postcode(code))
    mail = F.lower(X.strip(F.coalesce("email", F.lit(""))))
    staged = config.withColumns({"postcode": code, "email": mail})
    code_ok = checks.matches(F.col("postcode"), V.POSTCODE_PATTERN)
    mail_ok = checks.matches(F.col("email"), V.EMAIL_PATTERN)
    return staged.select(
        *[c for c in config.columns if c not in ("postcode", "email")],
        F.when(code_ok, F.col("postcode")).alias("postcode"),
        F.when(mail_ok, F.col("email")).alias("email"),
        (code_ok | (F.col("postcode") == "")).alias("postcode_ok"),
        (mail_ok | (F.col("email") == "")).alias("email_ok"),
    )
