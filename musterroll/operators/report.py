"""Change log, counts, top examples and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.contract import CONTRACT
from musterroll.operators.corrections import KEY
from musterroll.runtime import one_row_each

TOPK_SALTS = 64
# Lists of changes with the log that each belongs to, and all lists of a row.
ORIGINS = {"changes": "automatic", "fixes": "automatic", "patched": "manual"}
LISTS = (*ORIGINS, "errors")


def change_log(df: DataFrame, columns: tuple[str, ...] = ("changes", "fixes")) -> DataFrame:
    """One row per logged change."""
    entries = F.concat(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    return one_row_each(df, KEY, entries, "c").select(*KEY, "c.*")


def stats_total(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"))


def stats_by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("type").agg(F.count("*").alias("n"))


def stats_by_field(log: DataFrame) -> DataFrame:
    return log.groupBy("field").agg(F.count("*").alias("n"))


def stats_all(log: DataFrame) -> DataFrame:
    """Total, by type and by field in one pass over the log."""
    return log.groupingSets([["type"], ["field"], []], "type", "field").agg(F.count("*").alias("n"))


def error_stats(errors: DataFrame) -> DataFrame:
    return errors.groupBy("field", "message", "auto_fixable").agg(F.count("*").alias("n"))


def top_k(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """First ``k`` rows of each group, numbered in ``place``.

    Rows are ranked inside salted parts of a group first, so that a group with
    a large share of the table is never sorted by one task: the second ranking
    sees at most ``k`` rows per part.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(TOPK_SALTS))
    by_order = [F.col(c) for c in order]
    part = Window.partitionBy(*group, "_salt").orderBy(*by_order)
    whole = Window.partitionBy(*group).orderBy(*by_order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_part_place", F.row_number().over(part))
        .filter(F.col("_part_place") <= k)
        .withColumn("place", F.row_number().over(whole))
        .filter(F.col("place") <= k)
        .drop("_salt", "_part_place")
    )


def review(log: DataFrame, k: int = 10) -> DataFrame:
    """For each type: its count, the first ``k`` examples, and how many more.

    The log is used twice, so give it as a written table where it is long.
    """
    totals = log.groupBy("type").agg(F.count("*").alias("type_total"))  # one row per kind of fix
    shown = top_k(log, ["type"], [*KEY, "field_pos"], k)
    return shown.join(totals, "type").withColumn("more", F.greatest(F.col("type_total") - k, F.lit(0)))


def sorted_log(log: DataFrame) -> DataFrame:
    return log.orderBy("type", *KEY, "field_pos")


def sorted_manual_log(log: DataFrame) -> DataFrame:
    return log.orderBy(*KEY, "field_pos")


def all_changes(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """Both logs in one table, with their origin."""
    return automatic.withColumn("origin", F.lit("automatic")).unionByName(
        manual.withColumn("origin", F.lit("manual")), allowMissingColumns=True
    )


def skipped_list(skipped: DataFrame) -> DataFrame:
    """Skipped rows by their number on the sheet (first row is 1, after a header)."""
    return skipped.select("file", (F.col("row_idx") + 2).alias("sheet_row")).orderBy("file", "sheet_row")


def notes(final: DataFrame, repaired: Column | None = None, widths: DataFrame | None = None) -> DataFrame:
    """What the reports need of a run's rows, from a single read of them.

    The four lists of a row (``changes, fixes, patched, errors``) stand side by
    side: each place gives a row with at most one entry of each, and a row whose
    lists are all empty gives one row without entries.  ``first`` holds once for
    every row of the run.  Rows of the wrong width (``widths``) have the outcome
    ``width`` and no entries.
    """
    lists = F.posexplode_outer(F.arrays_zip(*LISTS)).alias("place", "entry")
    given = F.lit(False) if repaired is None else repaired
    kept = [*KEY, "outcome", F.coalesce(given, F.lit(False)).alias("repaired")]
    first = (F.coalesce("place", F.lit(0)) == 0).alias("first")
    rows = final.select(*kept, lists).select(*KEY, "outcome", "repaired", first, "entry.*")
    if widths is None:
        return rows
    wide = widths.select(*KEY, F.lit("width").alias("outcome"), F.lit(False).alias("repaired"), F.lit(True).alias("first"))
    return rows.unionByName(wide, allowMissingColumns=True)


def noted_changes(told: DataFrame) -> DataFrame:
    """Both logs in one table, with their origin, in one read of ``notes``."""
    entries = [F.struct(F.lit(origin).alias("origin"), F.col(name).alias("c")) for name, origin in ORIGINS.items()]
    one = one_row_each(told.select(*KEY, *ORIGINS), KEY, F.array(*entries)).filter(F.col("item.c").isNotNull())
    return one.select(*KEY, "item.c.*", "item.origin")


def noted_errors(told: DataFrame) -> DataFrame:
    """One row per open error."""
    return told.filter(F.col("errors").isNotNull()).select(*KEY, "errors.*")


def tally(told: DataFrame) -> DataFrame:
    """Counts of each file from ``notes``, added up before anything is shuffled."""
    rows = lambda cond: F.count_if(F.col("first") & cond)
    return told.groupBy("file").agg(
        F.count_if("first").alias("rows"),
        rows(F.col("outcome") == "valid").alias("valid_rows"),
        rows(F.col("outcome").isin("quarantine", "width")).alias("bad_rows"),
        rows(F.col("outcome").isin("skipped", "width")).alias("skipped"),
        rows(F.col("repaired")).alias("comma_repairs"),
        *[F.count(name).alias(f"n_{name}") for name in ORIGINS],
    )


def summary(counts: DataFrame) -> DataFrame:
    """Counts of a run from those of its files (``tally``).

    Rows of the wrong width count as rows, and as skipped.
    """
    total = lambda *names: F.coalesce(F.sum(sum(F.col(n) for n in names)), F.lit(0))
    return counts.agg(
        total("rows").alias("rows"),
        total("skipped").alias("skipped"),
        total("n_changes", "n_fixes").alias("automatic"),
        total("comma_repairs").alias("comma_repairs"),
        total("n_patched").alias("manual"),
    )


def export_decision(counts: DataFrame, max_error_rate: float = 1.0, reviewed: bool = True) -> DataFrame:
    """Per file: what would be written, what changed, and whether to write it.

    Rows of the wrong width are bad rows like any other.
    """
    changed = F.col("n_fixes") + F.col("n_patched")
    rate = F.col("bad_rows") / F.col("rows")
    return counts.select("file", "rows", "valid_rows", "bad_rows", changed.alias("total_changes")).withColumn(
        "decision",
        F.when(F.col("valid_rows") == 0, "no valid rows")
        .when((F.col("total_changes") > 0) & ~F.lit(reviewed), "cancelled")
        .when(rate > max_error_rate, "too many errors")
        .otherwise("export"),
    )


def field_labels(df: DataFrame, name_col: str = "field") -> DataFrame:
    """Attach the display label of a field name (a literal map, no join)."""
    pairs = F.create_map(*[x for f in CONTRACT for x in (F.lit(f.name), F.lit(f.label))])
    return df.withColumn("label", F.coalesce(F.element_at(pairs, F.col(name_col)), F.col(name_col)))
