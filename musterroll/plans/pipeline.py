"""The whole run: cells of many files in, contract rows and reports out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll import fixed_values as V
from musterroll.contract import BY_NAME, NAMES, REQUIRED, WIDTH
from musterroll.operators import align, corrections, normalize, ragged, report, rowrange, validate
from musterroll.runtime import tune, with_file_facts, written
from musterroll.sources import folder

KEY = ["file", "row_idx"]


@dataclass(frozen=True)
class Options:
    overrides: dict[str, str] = field(default_factory=dict)  # postcode / email for all rows
    min_header_matches: int = V.MIN_HEADER_MATCHES
    footer_match: str = "substring"
    min_confidence: float = V.MIN_CONFIDENCE
    accept_scored: bool = True
    expected_width: str = "header"  # or "contract": always twenty cells
    guard: str = "shape"
    iso_dayfirst: bool = False
    fix_policy: str = "accept"
    revalidate: bool = False
    max_error_rate: float = 1.0


@dataclass(frozen=True)
class Answers:
    """What people decided after an earlier run; every table is optional."""

    ranges: DataFrame | None = None  # file, header_idx, last_idx
    mapping_decisions: DataFrame | None = None  # file, accept
    mappings: DataFrame | None = None  # file, header, field
    medical: DataFrame | None = None  # file, row_idx, text
    decisions: DataFrame | None = None  # file, row_idx, field, accept
    defaults: DataFrame | None = None  # file, field, accept: constants for absent required fields
    patches: DataFrame | None = None  # file, row_idx, field, value
    skips: DataFrame | None = None  # file, row_idx


# What names the question that a row of each table answers.
ASKED = {
    "ranges": ["file"],
    "mapping_decisions": ["file"],
    "mappings": ["file", "header"],
    "defaults": ["file", "field"],
    "medical": KEY,
    "decisions": [*KEY, "field"],
    "patches": [*KEY, "field"],
    "skips": KEY,
}


@dataclass(frozen=True)
class Result:
    final: DataFrame  # every row of the right width, with errors, changes and outcome
    widths: DataFrame  # rows of the wrong width that could not be repaired
    bounds: DataFrame
    headers: DataFrame
    mapping: DataFrame
    positions: DataFrame
    rejected: DataFrame
    options: Options
    cells: DataFrame
    header_lists: DataFrame
    answers: Answers
    plan: DataFrame  # per file: bounds, positions and what it lacks
    redone: DataFrame | None = None  # files of which a later run worked out something again

    @property
    def valid(self) -> DataFrame:
        rows = self.final.filter(F.col("outcome") == "valid").select(*KEY, *NAMES)
        if self.options.max_error_rate < 1:
            held = written(self.export_decision().filter(F.col("decision") != "export").select("file"), "held")
            rows = rows.join(held, "file", "left_anti")
        return corrections.apply_overrides(rows, self.options.overrides)

    @property
    def quarantine(self) -> DataFrame:
        """Rows people should look at: open errors, or a wrong width."""
        bad = self.final.filter(F.col("outcome") == "quarantine").select(
            *KEY, F.lit("errors").alias("reason"), F.array(*NAMES).alias("cells"), "errors", F.lit(None).cast("string").alias("suggestion")
        )
        wide = self.widths.select(*KEY, "reason", "cells", F.lit(None).cast(self.final.schema["errors"].dataType).alias("errors"), "suggestion")
        return bad.unionByName(wide)

    @cached_property
    def notes(self) -> DataFrame:
        """What all reports are made from; written when the first of them is asked for."""
        return written(report.notes(self.final, F.col("repaired_by").isNotNull(), self.widths), "notes")

    @cached_property
    def tally(self) -> DataFrame:
        return written(report.tally(self.notes), "tally")

    @property
    def log(self) -> DataFrame:
        return report.noted_changes(self.notes)

    @property
    def automatic_log(self) -> DataFrame:
        return self.log.filter(F.col("origin") == "automatic").drop("origin")

    @property
    def manual_log(self) -> DataFrame:
        return self.log.filter(F.col("origin") == "manual").drop("origin")

    def summary(self) -> DataFrame:
        return report.summary(self.tally)

    def export_decision(self) -> DataFrame:
        return report.export_decision(self.tally, self.options.max_error_rate)

    @property
    def removed(self) -> DataFrame:
        """Rows outside the data, which no other table has."""
        return rowrange.removed_rows(self.cells, self.bounds)

    @property
    def patch_conflicts(self) -> DataFrame:
        """Cells for which people gave different values; their rows stay in quarantine."""
        none = self.cells.sparkSession.createDataFrame([], "file string, row_idx bigint, field string, values array<string>")
        given = self.answers
        if given.patches is not None:
            none = none.unionByName(corrections.patch_conflicts(given.patches))
        if given.medical is not None:
            texts = given.medical.select(*KEY, F.lit("medical_conditions").alias("field"), F.col("text").alias("value"))
            none = none.unionByName(corrections.patch_conflicts(texts))
        return none


class BadOverride(ValueError):
    pass


def checked_options(spark: SparkSession, options: Options) -> Options:
    """Bring override settings to their normal form, or refuse them."""
    unknown = sorted(set(options.overrides) - set(V.OVERRIDABLE_FIELDS))
    if unknown:
        raise BadOverride(f"Not a field with a default: {', '.join(unknown)}")
    given = {k: v for k, v in options.overrides.items() if v}
    if not given:
        return options
    row = corrections.checked_overrides(
        spark.createDataFrame([(given.get("postcode"), given.get("email"))], "postcode string, email string")
    ).first()
    bad = [n for n in V.OVERRIDABLE_FIELDS if not row[f"{n}_ok"]]
    if bad:
        raise BadOverride(f"Invalid default for: {', '.join(bad)}")
    return Options(**{**options.__dict__, "overrides": {n: row[n] for n in V.OVERRIDABLE_FIELDS if row[n]}})


def file_mapping(headers: DataFrame, options: Options, answers: Answers) -> DataFrame:
    exact = align.match_exact(headers)
    scores = align.match_score(align.match_unmatched(headers, exact))
    scored = align.match_conflict(align.match_best(scores, options.min_confidence), exact)
    scored = align.decide_scored(scored, options.accept_scored, answers.mapping_decisions)
    mapping = align.combine(exact, scored)
    if answers.mappings is not None:
        mapping = align.combine(exact, scored, align.match_manual(headers, mapping, answers.mappings))
    return mapping


def apply_answers(checked: DataFrame, options: Options, answers: Answers) -> DataFrame:
    """Fixes, then patches, then the outcome of each row."""
    fixed = corrections.apply_fixes(checked, options.fix_policy, answers.decisions)
    done = corrections.apply_patches(fixed, answers.patches, options.revalidate, options.overrides, options.iso_dayfirst)
    skipped: Column = F.lit(False)
    if answers.skips is not None:
        done = done.join(answers.skips.select(*KEY).distinct().withColumn("_skip", F.lit(True)), KEY, "left")
        skipped = F.col("_skip").isNotNull()
    outcome = F.when(skipped, "skipped").when(F.size("errors") == 0, "valid").otherwise("quarantine")
    return done.withColumn("outcome", outcome).drop("_skip")


def _logged_merge(final: DataFrame) -> DataFrame:
    """Log rows that were put together by a person's text as manual changes."""
    field = BY_NAME["medical_conditions"]
    entry = F.struct(
        F.lit(field.pos).alias("field_pos"),
        F.lit(field.label).alias("field"),
        F.col("_merged").alias("original"),
        F.col("medical_conditions").alias("corrected"),
        F.lit(corrections.PATCH_NOTE).alias("type"),
    )
    merge = F.when(F.col("repaired_by") == "patch", F.array(entry)).otherwise(F.array()).cast(normalize.CHANGE)
    return final.withColumn("patched", F.concat(merge, F.col("patched"))).drop("_merged")


def _rows_done(cells: DataFrame, plan: DataFrame, options: Options, answers: Answers) -> tuple[DataFrame, DataFrame]:
    """Rows of the right width with their outcome, and those of a wrong width; no row looks at another."""
    usable = plan.filter(F.col("unfilled").isNull()).drop("unfilled", "defaulted")
    data = with_file_facts(cells, usable, "end_idx").filter(
        (F.col("row_idx") > F.col("header_idx")) & (F.col("row_idx") <= F.col("last_idx"))
    )
    # A sheet's rows are all as wide as the sheet, so only text files have a width to keep.
    contract_width = F.when(F.col("file").rlike(r"(?i)\.xlsx?\z"), F.col("width")).otherwise(F.lit(WIDTH))
    mended = ragged.repair(
        data,
        F.col("width") if options.expected_width == "header" else contract_width,
        options.guard,
        answers.medical,
        F.col("p_medical_conditions"),
        F.col("p_date_of_birth"),
        F.col("p_address1"),
    )
    rows = ragged.repaired_rows(mended).withColumnRenamed("suggestion", "_merged")
    positions_kept = [c for c in usable.columns if c.startswith("p_")]
    fields = rows.select(*KEY, "repaired_by", "_merged", *positions_kept, *[F.get("cells", F.col(f"p_{n}")).alias(n) for n in NAMES])
    fields = align.with_missing_defaults(fields, options.overrides).drop(*positions_kept)
    checked = written(
        validate.validate_table(
            normalize.normalize_table(fields, options.iso_dayfirst), options.overrides, options.iso_dayfirst, normalized=True
        ),
        "checked",
    )
    # By outcome, so that what is written and what is kept back are together one read.
    final = written(_logged_merge(apply_answers(checked, options, answers)), "final", ["outcome"])
    return final, written(ragged.width_quarantine(mended).select(*KEY, "reason", "cells", "suggestion"), "widths")


def clean_cells(cells: DataFrame, options: Options = Options(), answers: Answers = Answers()) -> Result:
    """Run all stages on ``file, row_idx, cells``.

    Tables that are used more than once are written to the shared folder:
    the cells, the small per-file plan, and the checked rows.
    """
    spark = tune(cells.sparkSession)
    options = checked_options(spark, options)
    cells = written(cells.select(*KEY, "cells"), "cells")

    bounds = written(
        rowrange.override_range(
            rowrange.detect_range(cells, options.min_header_matches, options.footer_match), answers.ranges
        ),
        "bounds",
    )
    # Headers stand near the top: one number from the bounds lets the scan
    # skip all row groups below.
    deepest = bounds.agg(F.max("header_idx")).first()[0] or 0
    head = rowrange.header_rows(cells.filter(F.col("row_idx") <= deepest), bounds)
    lists = written(align.header_lists(head), "header-lists")
    headers = written(align.headers_of(head), "headers")
    mapping = written(file_mapping(headers, options, answers), "mapping")
    positions = written(align.field_positions(headers, mapping), "positions")
    verdict = align.missing_default(positions, options.overrides, answers.defaults)

    # A header row without cells gives no positions, but its file is in the plan all the same.
    nothing = F.when(F.col("width").isNull(), F.lit(REQUIRED[0].label))
    plan = bounds.join(positions, "file", "left").join(verdict, "file", "left")
    plan = written(plan.withColumn("unfilled", F.coalesce("unfilled", nothing)), "plan")
    # Nothing is lost with a file that ends at its header, but it must not go unnoticed.
    bare = F.col("last_idx") <= F.col("header_idx")
    reason = F.when(bare, folder.NO_DATA).otherwise(F.concat(F.lit("Missing mandatory field: "), F.col("unfilled")))
    rejected = plan.filter(F.col("unfilled").isNotNull() | bare).select("file", reason.alias("reason"))

    final, widths = _rows_done(cells, plan, options, answers)
    return Result(
        final=final,
        widths=widths,
        bounds=bounds,
        headers=headers,
        mapping=mapping,
        positions=positions,
        rejected=rejected,
        options=options,
        cells=cells,
        header_lists=lists,
        answers=answers,
        plan=plan,
    )


def _all_answers(earlier: Answers, later: Answers) -> Answers:
    """Both; a later answer takes the place of earlier ones to the same question."""
    both = {}
    for name, key in ASKED.items():
        old, new = getattr(earlier, name), getattr(later, name)
        if old is not None and new is not None:
            new = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
        both[name] = old if new is None else new
    return Answers(**both)


def _asked(answers: Answers, by_row: bool) -> DataFrame | None:
    """Files, or rows of files, that answers speak of."""
    given = [(getattr(answers, name), key) for name, key in ASKED.items()]
    named = [t.select(KEY if by_row else ["file"]) for t, key in given if t is not None and ("row_idx" in key) == by_row]
    return reduce(DataFrame.unionByName, named).distinct() if named else None


def answered(result: Result, answers: Answers) -> Result:
    """The run with more answers, equal to a whole run with all of them.

    Answers about a file (range, mapping, default) work out that file again from
    its cells, and answers about a row that row alone; everything else is taken
    from the earlier run.  A later answer takes the place of earlier ones to the
    same question.  Answers about files and rows that the run doesn't have change
    nothing.  ``redone`` has the files whose outputs may differ.
    """
    together = _all_answers(result.answers, answers)
    files, rows = _asked(answers, False), _asked(answers, True)
    out = replace(result, answers=together, redone=None)
    redone = []
    known = result.bounds.select("file")
    if files is not None:
        files = written(files.join(known, "file", "left_semi"), "answered-files")
        again = clean_cells(_of(result.cells, files, ["file"]), result.options, together)
        parts = ("final", "widths", "bounds", "headers", "mapping", "positions", "rejected", "header_lists", "plan")
        out = _exchanged(out, parts, files, ["file"], again)
        redone.append(files)
    if rows is not None:
        rows = rows.join(known, "file", "left_semi")
        rows = written(rows if files is None else rows.join(files, "file", "left_anti"), "answered-rows")
        final, widths = _rows_done(_of(result.cells, rows, KEY), out.plan, result.options, together)
        out = _exchanged(out, ("final", "widths"), rows, KEY, replace(result, final=final, widths=widths))
        redone.append(rows.select("file").distinct())
    return replace(out, redone=reduce(DataFrame.unionByName, redone).distinct() if redone else None)


def _of(cells: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Cells of some files or rows.

    The first and last of their names bound what is read: the row groups of
    files outside are skipped by their statistics.
    """
    low, high = asked.agg(F.min("file"), F.max("file")).first()
    near = cells.limit(0) if low is None else cells.filter(F.col("file").between(low, high))
    return near.join(asked, key, "left_semi")


def _exchanged(result: Result, names: Iterable[str], asked: DataFrame, key: list[str], new: Result) -> Result:
    """A run with the rows of some tables replaced where ``key`` is among those asked."""
    return replace(result, **{n: getattr(result, n).join(asked, key, "left_anti").unionByName(getattr(new, n)) for n in names})


def clean_folder(spark: SparkSession, path: str, options: Options = Options(), answers: Answers = Answers()) -> Result:
    """Scan a folder and run all stages; unreadable and empty files are rejected.

    Every row of every listed file is then a header, removed, valid, in
    quarantine, skipped, or in a rejected file.
    """
    files = folder.list_files(spark, path)
    scan = folder.scan_folder(spark, path, files)
    result = clean_cells(scan.cells, options, answers)
    lost = folder.rejected_files(files, result.bounds, scan.rejected)
    return replace(result, rejected=result.rejected.unionByName(lost))


def write_result(result: Result, path: str, by_file: bool = False) -> None:
    """Write what people review, and then the contract rows, under ``path``.

    A run keeps its intermediate tables in the shared folder; what is written
    here is complete without them.  The reports come first, so that a run
    without a valid row can be answered all the same; ``NothingToWrite`` is
    raised last.  The run's rows are read twice: for the notes from which all
    reports are made, and by outcome for the quarantine and the valid rows.  ``by_file`` gives one output per input file, in row order.
    """
    result.log.write.parquet(f"{path}/changes")
    log = result.log.sparkSession.read.schema(result.log.schema).parquet(f"{path}/changes")
    automatic = log.filter(F.col("origin") == "automatic").drop("origin")
    skipped = result.notes.filter(F.col("first") & (F.col("outcome") == "skipped"))
    tables = {
        "quarantine": result.quarantine,
        "removed_rows": result.removed,
        "rejected_files": result.rejected,
        "bounds": result.bounds,
        "removed_preview": rowrange.trim_preview(result.cells, result.bounds),
        "mapping": align.mapping_report(result.headers, result.mapping),
        "open_choices": align.open_choices(result.headers, result.mapping),
        "missing_columns": align.missing_report(result.positions, result.header_lists),
        "stats": report.stats_all(log),
        "examples": report.review(automatic),
        "errors": report.error_stats(report.noted_errors(result.notes)),
        "skipped": report.skipped_list(skipped),
        "patch_conflicts": result.patch_conflicts,
        "export_decision": result.export_decision(),
        "summary": result.summary(),
    }
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    valid = result.valid
    if by_file:
        folder.write_contract_by_file(valid, f"{path}/valid")
    else:
        folder.write_contract(valid, f"{path}/valid")
