"""One query per operator, over whole tables derived from the supplied ones."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from musterroll import fixed_values as V
from musterroll.contract import CONTRACT, NAMES, fields_table
from musterroll.functions import checks, text as X
from musterroll.operators import align, corrections, normalize, ragged, report, rowrange, validate
from musterroll.plans import books, derived as D, pipeline
from musterroll.runtime import file_uri, new_folder, tune, written
from musterroll.sources import delimited, folder, named, workbook

KEY = ["file", "row_idx"]
Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        CATALOGUE[name] = run
        return fn

    return add


# --- shared inputs -------------------------------------------------------------


def _normal(spark, sf):
    return normalize.normalize_table(D.members(spark, sf).drop("file_no"))


def _checked(spark, sf):
    return validate.validate_table(_normal(spark, sf), normalized=True)


def _raw_checked(spark, sf):
    return validate.validate_table(D.members(spark, sf).drop("file_no"))


def _written_checked(spark, sf):
    """Checked rows as the pipeline leaves them for the later stages."""
    return written(_checked(spark, sf), "checked")


def _fixed(spark, sf, decisions=True):
    given = D.decisions(spark, sf) if decisions else None
    return corrections.apply_fixes(_written_checked(spark, sf), "accept", given)


def _final(spark, sf):
    answers = pipeline.Answers(decisions=D.decisions(spark, sf), patches=D.patches(spark, sf), skips=D.skips(spark, sf))
    return pipeline.apply_answers(_written_checked(spark, sf), pipeline.Options(), answers)


def _auto_log(spark, sf):
    return report.change_log(_fixed(spark, sf))


def _bounds(spark, sf, cells=None):
    return rowrange.detect_range(D.cells(spark, sf) if cells is None else cells)


def _headers(spark, sf):
    cells = D.cells(spark, sf)
    return align.headers_of(rowrange.header_rows(cells, _bounds(spark, sf, cells)))


def _header_lists(spark, sf):
    cells = D.cells(spark, sf)
    rows = rowrange.header_rows(cells, _bounds(spark, sf, cells))
    return written(align.header_lists(rows), "header-lists")


def _file_parity(files: DataFrame) -> Column:
    return F.substring("file", 9, 6).cast("int") % 2


def _mapping(spark, sf, headers=None):
    headers = _headers(spark, sf) if headers is None else headers
    return pipeline.file_mapping(headers, pipeline.Options(), pipeline.Answers())


def _written_headers(spark, sf):
    """Headers are few and used many times, so they are written once."""
    return written(_headers(spark, sf), "headers")


def _positions(spark, sf, lists=None):
    """Positions of the fields, from header lists that are written already or from the cells."""
    headers = _written_headers(spark, sf) if lists is None else align.headers_of(lists.withColumnRenamed("headers", "cells"))
    return align.field_positions(headers, _mapping(spark, sf, headers))


def _one_error(spark, sf, *names: str, raw: bool = True) -> DataFrame:
    rows = _raw_checked(spark, sf) if raw else _checked(spark, sf)
    return validate.error_table(rows).filter(F.col("field").isin(*names)).drop("field_pos")


# --- sources and sinks ----------------------------------------------------------


def _marked(cells: DataFrame) -> DataFrame:
    """Put a quote and a line break into some cells."""
    odd = F.lit('Ver"tigo\nat height')
    some = (F.col("row_idx") % 5 == 0) & (F.size("cells") == 20)
    new = F.transform("cells", lambda c: F.when((c == "Vertigo") & some, odd).otherwise(c))
    return cells.withColumn("cells", new)


def _as_line(cells: Column) -> Column:
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(cells, lambda c: F.when(c.rlike('[",\n]'), quote(c)).otherwise(c)), ",")


def _scanned(spark, sf) -> DataFrame:
    """Write the cells as text, one folder per member file, and scan them."""
    where = new_folder(spark, "delimited")
    lines = _marked(D.cells(spark, sf)).select("file", "row_idx", _as_line(F.col("cells")).alias("value"))
    ordered = lines.repartitionByRange("file", "row_idx").sortWithinPartitions("file", "row_idx")
    ordered.select("file", "value").write.partitionBy("file").text(where)
    rows = delimited.scan_delimited(spark, where, "part-*")
    return rows.withColumnRenamed("file", "part").withColumn("file", F.regexp_extract("part", "file=([^/]+)/", 1))


def _row_text() -> Column:
    return F.array_join("cells", "|").alias("row_text")


@query("scan_ragged")
def scan_ragged(spark, sf):
    return _scanned(spark, sf).select("file", F.size("cells").cast("long").alias("n_cells"), _row_text())


@query("row_index")
def row_index(spark, sf):
    """Positions within a member file, whose parts follow each other by name."""
    rows = _scanned(spark, sf)
    parts = rows.groupBy("file", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").select("file", (F.col("start") + F.col("row_idx")).alias("row_idx"), _row_text())


_SHEET_BITS = 14


def _workbook(rows: pd.DataFrame) -> pd.DataFrame:
    """A small workbook with the given rows (inline text cells)."""
    rows = rows.sort_values("row_idx")
    base = int(rows["row_idx"].iloc[0]) >> _SHEET_BITS << _SHEET_BITS

    def line(at, cells):
        inner = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in cells)
        return f'<row r="{at - base + 1}">{inner}</row>'

    body = "".join(line(i, c) for i, c in zip(rows["row_idx"], rows["cells"]))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return pd.DataFrame({"path": [f"{rows['file'].iloc[0]}#{base}"], "content": [out.getvalue()]})


@query("scan_xlsx")
def scan_xlsx(spark, sf):
    """Build workbooks of at most 16384 rows each, then read them."""
    rows = D.cells(spark, sf).withColumn("sheet", F.shiftright("row_idx", _SHEET_BITS))
    books = rows.groupBy("file", "sheet").applyInPandas(_workbook, "path string, content binary")
    read = workbook.read_workbooks(books).filter(F.col("problem").isNull())
    base = F.substring_index("file", "#", -1).cast("long")
    return read.select(
        F.substring_index("file", "#", 1).alias("file"), (base + F.col("row_idx")).alias("row_idx"), _row_text()
    )


@query("scan_xls")
def scan_xls(spark, sf):
    """The same sheets in the old format."""
    rows = D.cells(spark, sf).withColumn("sheet", F.shiftright("row_idx", _SHEET_BITS))
    made = rows.groupBy("file", "sheet").applyInPandas(_old_workbook, "path string, content binary")
    read = workbook.read_workbooks(made).filter(F.col("problem").isNull())
    base = F.substring_index("file", "#", -1).cast("long")
    return read.select(F.substring_index("file", "#", 1).alias("file"), (base + F.col("row_idx")).alias("row_idx"), _row_text())


def _old_workbook(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row_idx")
    base = int(rows["row_idx"].iloc[0]) >> _SHEET_BITS << _SHEET_BITS
    held = {i - base: list(c) for i, c in zip(rows["row_idx"], rows["cells"])}
    sheet = [held.get(i, []) for i in range(max(held) + 1)]
    return pd.DataFrame({"path": [f"{rows['file'].iloc[0]}#{base}"], "content": [books.old_workbook(sheet)]})


_KINDS = (".csv", ".XLSX", ".txt", ".xls", " head.csv", " none.csv")


def _member_folder(spark, sf) -> tuple[DataFrame, str]:
    """A folder with one file per member file, and the name that each path in it stands for.

    By number in turn: text, both kinds of workbook, a kind that nothing
    reads, a header alone, and no byte at all.
    """
    number = F.regexp_extract("file", "([0-9]+)", 1).cast("int")
    kind = (number % len(_KINDS)).alias("kind")
    name = F.concat(F.substring("file", 1, 14), F.get(F.array(*[F.lit(k) for k in _KINDS]), kind)).alias("name")
    rows = written(D.cells(spark, sf).select("file", "row_idx", "cells", kind, name), "member-cells")
    zero = F.lit(0).cast("bigint")
    lines = rows.filter(F.col("kind").isin(0, 2)).select("name", F.col("row_idx").alias("place"), F.concat(_as_line(F.col("cells")), F.lit("\n")).cast("binary").alias("content"))
    heads = rows.select("name", "kind").filter(F.col("kind").isin(4, 5)).distinct()
    header = F.concat(_as_line(F.array(*[F.lit(f.header) for f in CONTRACT])), F.lit("\n"))
    heads = heads.select("name", zero.alias("place"), F.when(F.col("kind") == 4, header).otherwise("").cast("binary").alias("content"))
    sheet = rows.select(F.col("name").alias("file"), "row_idx", "cells", "kind")
    sheets = [
        sheet.filter(F.col("kind") == kind).drop("kind").groupBy("file").applyInPandas(make, "path string, content binary")
        for kind, make in ((1, _workbook), (3, _old_workbook))
    ]
    pieces = lines.unionByName(heads)
    for made in sheets:
        pieces = pieces.unionByName(made.select(F.substring_index("path", "#", 1).alias("name"), zero.alias("place"), "content"))
    where = new_folder(spark, "members")
    named.write_named(pieces.withColumn("part", zero), where)
    names = named.manifest(spark, where).select("name", file_uri(F.col("output")).alias("file"))
    return written(names, "member-names"), f"{where}/data"


def _under_names(table: DataFrame, names: DataFrame) -> DataFrame:
    return table.join(names, "file").withColumn("file", F.col("name")).drop("name")


@query("scan_dispatch")
def scan_dispatch(spark, sf):
    """What reads each file of a folder."""
    names, where = _member_folder(spark, sf)
    return _under_names(folder.list_files(spark, where).select("file", "reader", "reason"), names)


@query("scan_folder")
def scan_folder(spark, sf):
    """All rows of a folder of text files and both kinds of workbook."""
    names, where = _member_folder(spark, sf)
    return _under_names(folder.scan_folder(spark, where).cells, names).select("file", "row_idx", _row_text())


@query("empty_input")
def empty_input(spark, sf):
    """Files of a folder that nothing can be read from: of no known kind, without a byte, or with a header alone."""
    names, where = _member_folder(spark, sf)
    files = folder.list_files(spark, where)
    scan = folder.scan_folder(spark, where, files)
    bounds = rowrange.detect_range(written(scan.cells, "cells"))
    return _under_names(folder.rejected_files(files, bounds.filter(F.col("last_idx") > F.col("header_idx")), scan.rejected), names)


@query("file_accounting")
def file_accounting(spark, sf):
    """Rows that a whole run over a folder leaves of each file, header and rejected files included."""
    names, where = _member_folder(spark, sf)
    run = pipeline.clean_folder(spark, where)
    gone = run.rejected.select("file", F.lit(True).alias("rejected")).distinct()
    one = F.lit(1).cast("long").alias("n")
    held = run.final.select("file", one)
    for part in (run.widths, run.removed):
        held = held.unionByName(part.select("file", one))
    rows = held.groupBy("file").agg(F.sum("n").alias("rows"))
    every = folder.list_files(spark, where).select("file").join(gone, "file", "left").join(rows, "file", "left")
    return _under_names(every.select("file", F.coalesce("rejected", F.lit(False)).alias("rejected"), F.coalesce("rows", F.lit(0)).alias("rows")), names)


@query("sink_csv")
def sink_csv(spark, sf):
    where = new_folder(spark, "contract")
    folder.write_contract(_normal(spark, sf), where)
    return folder.read_contract(spark, where)


@query("sink_by_file")
def sink_by_file(spark, sf):
    """One output per input file, read back with the file that each row came from."""
    where = new_folder(spark, "by-file")
    folder.write_contract_by_file(_normal(spark, sf), where)
    return folder.read_contract(spark, where, by_file=True)


@query("sink_guard")
def sink_guard(spark, sf):
    """What the sink wrote of each file, and the files of which it had nothing to write.

    The checked rows are written first: a filter on them would otherwise be
    pushed, with all rules inside, below the redistribution of the input.
    """
    checked = _written_checked(spark, sf)
    where = new_folder(spark, "guarded")
    folder.write_contract_by_file(checked.filter(F.size("errors") == 0), where)
    wrote = named.manifest(spark, where).groupBy(F.col("name").alias("file")).agg(F.sum("rows").alias("valid_rows"))
    rows = checked.select("file").distinct().join(wrote, "file", "left").select("file", F.coalesce("valid_rows", F.lit(0)).alias("valid_rows"))
    return rows.withColumn("refused", F.col("valid_rows") == 0)


# --- row range -------------------------------------------------------------------


def _cells_with(column: Callable[[Column], Column], name: str) -> Query:
    return lambda spark, sf: D.cells(spark, sf).select(*KEY, column(F.col("cells")).alias(name))


query("header_score")(_cells_with(lambda c: rowrange.header_score(c).cast("long"), "score"))
query("is_empty_row")(_cells_with(rowrange.is_empty_row, "is_empty"))
query("is_likely_data")(_cells_with(rowrange.is_likely_data, "is_likely"))


@query("summary_keywords")
def summary_keywords(spark, sf):
    c = F.col("cells")
    return D.cells(spark, sf).select(
        *KEY, rowrange.has_summary_word(c).alias("inside"), rowrange.has_summary_word(c, "word").alias("whole_word")
    )


@query("header_row")
def header_row(spark, sf):
    hit = rowrange.header_score(F.col("cells")) >= V.MIN_HEADER_MATCHES
    return D.cells(spark, sf).groupBy("file").agg(F.min(F.when(hit, F.col("row_idx"))).alias("named_idx"))


@query("header_fallback")
def header_fallback(spark, sf):
    ok = (F.col("row_idx") < rowrange.HEAD_ROWS) & rowrange.looks_like_header(F.col("cells"))
    return D.cells(spark, sf).groupBy("file").agg(F.min(F.when(ok, F.col("row_idx"))).alias("wordy_idx"))


query("last_data_row")(lambda spark, sf: _bounds(spark, sf).select("file", "last_idx"))
query("detect_range")(_bounds)


@query("trim_rows")
def trim_rows(spark, sf):
    cells = D.cells(spark, sf)
    return rowrange.trim_rows(cells, _bounds(spark, sf, cells)).select(*KEY, "data_idx", F.size("cells").cast("long").alias("n_cells"))


@query("trim_decision")
def trim_decision(spark, sf):
    bounds = _bounds(spark, sf)
    keep_all = bounds.filter(_file_parity(bounds) == 0).select(
        "file", F.lit(0).cast("long").alias("header_idx"), F.lit(None).cast("long").alias("last_idx")
    )
    return rowrange.override_range(bounds, keep_all)


@query("trim_preview")
def trim_preview(spark, sf):
    cells = D.cells(spark, sf)
    return rowrange.trim_preview(cells, _bounds(spark, sf, cells))


query("trim_counts")(lambda spark, sf: rowrange.trim_counts(_bounds(spark, sf)))


# --- schema alignment ------------------------------------------------------------


@query("header_norm")
def header_norm(spark, sf):
    return _headers(spark, sf).select("file", F.col("pos").cast("long"), "header", align.header_norm(F.col("header")).alias("norm"))


@query("match_exact")
def match_exact(spark, sf):
    return align.match_exact(_headers(spark, sf)).withColumns(
        {"tier": F.col("tier").cast("long"), "pos": F.col("pos").cast("long")}
    )


@query("match_score")
def match_score(spark, sf):
    return align.match_score(_headers(spark, sf)).drop("field_pos").withColumn("pos", F.col("pos").cast("long"))


@query("match_best")
def match_best(spark, sf):
    return align.match_best(align.match_score(_headers(spark, sf)))


@query("match_unmatched")
def match_unmatched(spark, sf):
    headers = _written_headers(spark, sf)
    return align.match_unmatched(headers, align.match_exact(headers)).withColumn("pos", F.col("pos").cast("long"))


def _scored(spark, sf):
    headers = _written_headers(spark, sf)
    exact = align.match_exact(headers)
    best = align.match_best(align.match_score(align.match_unmatched(headers, exact)))
    return align.match_conflict(best, exact)


query("match_conflict")(_scored)


@query("match_decision")
def match_decision(spark, sf):
    scored = _scored(spark, sf)
    files = scored.select("file").distinct()
    return align.decide_scored(scored, True, files.select("file", (_file_parity(files) == 0).alias("accept")))


_MANUAL = {"Student First Name": "first_name", "Health Notes": "classified_as_disabled", "Notes": "gender", "Column B": "first_name"}


@query("match_manual")
def match_manual(spark, sf):
    headers = _written_headers(spark, sf)
    pairs = F.create_map(*[F.lit(x) for kv in _MANUAL.items() for x in kv])
    given = headers.select("file", "header", F.element_at(pairs, F.col("header")).alias("field")).filter("field is not null")
    return align.match_manual(headers, _mapping(spark, sf, headers), given)


@query("match_manual_choices")
def match_manual_choices(spark, sf):
    headers = _written_headers(spark, sf)
    return align.open_choices(headers, _mapping(spark, sf, headers)).withColumn("choices", F.array_join("choices", ","))


@query("missing_mandatory")
def missing_mandatory(spark, sf):
    return align.missing_fields(_positions(spark, sf), True).select("file", "field", "label")


@query("missing_optional")
def missing_optional(spark, sf):
    return align.missing_fields(_positions(spark, sf), False).select("file", "field", "label")


@query("missing_default")
def missing_default(spark, sf):
    return align.missing_default(_positions(spark, sf), {"postcode": "SW1A 1AA"})


@query("suggest_headers")
def suggest_headers(spark, sf):
    lists = _header_lists(spark, sf)
    missing = align.missing_fields(_positions(spark, sf, lists), True)
    return align.suggest_headers(lists, missing).select("file", "field", F.array_join("suggestions", "|").alias("suggestions"))


@query("apply_mapping")
def apply_mapping(spark, sf):
    cells = D.cells(spark, sf)
    bounds = written(_bounds(spark, sf, cells), "bounds")
    headers = written(align.headers_of(rowrange.header_rows(cells, bounds)), "headers")
    plan = bounds.join(align.field_positions(headers, _mapping(spark, sf, headers)), "file")
    rows = pipeline.with_file_facts(cells, written(plan, "plan"), "end_idx")
    inside = (F.col("row_idx") > F.col("header_idx")) & (F.col("row_idx") <= F.col("last_idx"))
    return align.take_fields(rows.filter(inside)).select(*KEY, *NAMES)


# --- ragged rows -----------------------------------------------------------------


def _repair(spark, sf, guard="shape", patches=False):
    given = None
    if patches:
        given = D.skips(spark, sf).select(*KEY, F.lit("Asthma, mild").alias("text"))
    return ragged.repair(D.ragged(spark, sf), guard=guard, medical_patches=given)


@query("check_width")
def check_width(spark, sf):
    wrong = ragged.check_width(D.ragged(spark, sf)).filter(F.col("extra_n") != 0)
    return wrong.select(*KEY, *[F.col(c).cast("long") for c in ("expected_n", "actual_n", "extra_n")])


@query("repair_commas")
def repair_commas(spark, sf):
    rows = ragged.repaired_rows(_repair(spark, sf))
    return rows.select(*KEY, F.array_join("cells", "|").alias("row_text"), F.col("repaired_by").isNotNull().alias("repaired"))


@query("looks_like_address")
def looks_like_address(spark, sf):
    m = D.members(spark, sf)
    return m.select("k", *[ragged.looks_like_address(F.col(c)).alias(c) for c in ("address1", "surname", "town_city", "date_of_birth", "email")])


@query("repair_guard")
def repair_guard(spark, sf):
    shape = _repair(spark, sf).filter("extra_n > 0").select(*KEY, (F.col("repaired_by") == "guard").alias("ok"))
    parity = _repair(spark, sf, "parity").filter("extra_n > 0").select(*KEY, (F.col("repaired_by") == "guard").alias("ok"))
    both = shape.withColumn("guard", F.lit("shape")).unionByName(parity.withColumn("guard", F.lit("parity")))
    return both.withColumn("ok", F.coalesce("ok", F.lit(False)))


@query("repair_quarantine")
def repair_quarantine(spark, sf):
    left = ragged.width_quarantine(_repair(spark, sf))
    return left.select(*KEY, "reason", "suggestion", F.array_join("cells", "|").alias("row_text"))


@query("repair_patch")
def repair_patch(spark, sf):
    done = _repair(spark, sf, "parity", patches=True).filter("repaired_by is not null")
    return done.select(*KEY, "repaired_by", F.array_join("repaired", "|").alias("row_text"))


query("repair_count")(lambda spark, sf: ragged.repair_count(_repair(spark, sf)))


# --- normalisation ---------------------------------------------------------------


def _normal_fields(*names: str) -> Query:
    return lambda spark, sf: _normal(spark, sf).select("k", *names)


query("norm_row")(_normal_fields(*NAMES))
query("norm_name_case")(_normal_fields("first_name", "surname"))
query("norm_enum_case")(_normal_fields("gender", "classified_as_disabled"))
query("norm_email")(_normal_fields("email"))
query("norm_postcode")(_normal_fields("postcode"))
query("norm_phone")(_normal_fields("phone_number", "emergency_contact_phone", "emergency_contact_phone2"))
query("norm_date")(_normal_fields("date_of_birth"))
query("norm_integer")(_normal_fields("school_year", "course_id"))


@query("norm_date_iso_dayfirst")
def norm_date_iso_dayfirst(spark, sf):
    return normalize.normalize_table(D.members(spark, sf), iso_dayfirst=True).select("k", "date_of_birth")


@query("norm_string")
def norm_string(spark, sf):
    """Text of strings, whole and broken numbers, and missing values."""
    c = D.table(spark, sf, "customer")
    half = F.floor("c_acctbal").cast("double") + F.when(F.col("c_custkey") % 2 == 0, 0.5).otherwise(0.0)
    shown = c.select(
        "c_custkey",
        F.concat(F.lit(" \t"), "c_name", F.lit("\n ")).alias("padded"),
        half.alias("number"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("absent"),
    )
    kinds = {f.name: f.dataType for f in shown.schema.fields}
    return shown.select("c_custkey", *[X.as_text(F.col(n), kinds[n]).alias(n) for n in ("padded", "number", "absent")])


@query("norm_date_serial")
def norm_date_serial(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 7 + 0.75).alias("date_of_birth"))
    return normalize.normalize_table(o).select("o_orderkey", "date_of_birth")


@query("norm_date_object")
def norm_date_object(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("date_of_birth"))
    return normalize.normalize_table(o).select("o_orderkey", "date_of_birth")


# --- validation ------------------------------------------------------------------

query("val_dispatch")(lambda spark, sf: validate.error_table(_raw_checked(spark, sf)).drop("field_pos"))
query("val_row")(lambda spark, sf: validate.error_table(_checked(spark, sf)).drop("field_pos"))
query("val_email")(lambda spark, sf: _one_error(spark, sf, "email"))
query("val_postcode")(lambda spark, sf: _one_error(spark, sf, "postcode"))
query("val_integer")(lambda spark, sf: _one_error(spark, sf, "school_year", "course_id"))
query("val_phone")(lambda spark, sf: _one_error(spark, sf, "phone_number", "emergency_contact_phone", "emergency_contact_phone2"))
query("val_enum")(lambda spark, sf: _one_error(spark, sf, "classified_as_disabled"))
query("val_gender")(lambda spark, sf: _one_error(spark, sf, "gender"))


def _date_errors(*messages: str) -> Query:
    return lambda spark, sf: _one_error(spark, sf, "date_of_birth").filter(F.col("message").isin(*messages))


query("val_date_uk")(_date_errors(V.MSG_DATE_US, V.MSG_DATE_RANGE))
query("val_date_convert")(_date_errors(V.MSG_DATE_CONVERT))
query("val_date_bad")(_date_errors(V.MSG_DATE_BAD))


@query("val_required")
def val_required(spark, sf):
    return validate.error_table(_raw_checked(spark, sf)).filter(F.col("message").endswith(" is required")).drop("field_pos")


@query("val_pattern")
def val_pattern(spark, sf):
    m = D.members(spark, sf)
    return m.select(
        "k",
        checks.matches(F.col("postcode"), V.POSTCODE_PATTERN).alias("postcode_ok"),
        checks.matches(F.col("email"), V.EMAIL_PATTERN).alias("email_ok"),
        checks.matches(F.col("phone_number"), V.PHONE_PATTERN).alias("phone_ok"),
    )


@query("row_flags")
def row_flags(spark, sf):
    return validate.with_row_flags(_checked(spark, sf)).select(*KEY, "is_valid", "has_auto_fixable", "has_manual")


@query("row_label")
def row_label(spark, sf):
    return _normal(spark, sf).select(*KEY, validate.row_label().alias("row_label"))


@query("field_label")
def field_label(spark, sf):
    """Labels of the logged fields, and of cells by position."""
    errors = validate.error_table(_checked(spark, sf))
    labels = F.broadcast(fields_table(spark).select("field_pos", F.col("label").alias("by_pos")))  # twenty rows
    return report.field_labels(errors).join(labels, "field_pos").select(*KEY, "field", "label", "by_pos")


@query("val_skip_fields")
def val_skip_fields(spark, sf):
    rows = validate.validate_table(_normal(spark, sf), skip_fields=V.OVERRIDABLE_FIELDS, normalized=True)
    return validate.error_table(rows).drop("field_pos")


# --- corrections -----------------------------------------------------------------


@query("split_pending")
def split_pending(spark, sf):
    sized = _checked(spark, sf).withColumn("pending", F.size("errors") > 0)
    return sized.groupBy("file", "pending").agg(F.count("*").alias("n"), F.sum(F.size("errors").cast("long")).alias("n_errors"))


@query("fix_auto")
def fix_auto(spark, sf):
    return _fixed(spark, sf, decisions=False).select(*KEY, *[f.name for f in CONTRACT if f.can_suggest])


@query("fix_type")
def fix_type(spark, sf):
    """On values that were not normalised first, where every class occurs."""
    errors = validate.error_table(_raw_checked(spark, sf)).filter("auto_fixable")
    kind = corrections.fix_type(F.col("field"), F.col("message"))
    return errors.select(*KEY, "field", "value", "suggested", kind.alias("type"))


@query("fix_policy")
def fix_policy(spark, sf):
    out = None
    checked = _written_checked(spark, sf)
    for policy in ("accept", "review"):
        rows = corrections.apply_fixes(checked, policy, D.decisions(spark, sf))
        part = rows.select(
            F.lit(policy).alias("policy"), *KEY, "gender", "date_of_birth",
            F.size("fixes").cast("long").alias("n_fixes"), F.size("errors").cast("long").alias("n_open"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("fix_manual")
def fix_manual(spark, sf):
    rows = corrections.apply_patches(_fixed(spark, sf), D.patches(spark, sf))
    return rows.select(*KEY, *NAMES, F.size("patched").cast("long").alias("n_patched"), F.size("errors").cast("long").alias("n_open"))


@query("fix_manual_revalidate")
def fix_manual_revalidate(spark, sf):
    """Bad answers are caught when patched rows are checked again."""
    bad = D.patches(spark, sf).withColumn("value", F.when(F.col("field") == "school_year", "99").otherwise(F.col("value")))
    rows = corrections.apply_patches(_fixed(spark, sf), bad, revalidate=True)
    return validate.error_table(rows).select(*KEY, "field", "value", "message")


@query("row_skip")
def row_skip(spark, sf):
    return _final(spark, sf).groupBy("file", "outcome").agg(F.count("*").alias("n"))


@query("skip_filter")
def skip_filter(spark, sf):
    return corrections.drop_skipped(_normal(spark, sf), D.skips(spark, sf)).select(*KEY, "k")


_DEFAULTS = {"postcode": "SW1A 1AA", "email": "office@club.org", "classified_as_disabled": "No"}


@query("default_fill")
def default_fill(spark, sf):
    return normalize.fill_defaults(_normal(spark, sf), _DEFAULTS).select(*KEY, *_DEFAULTS)


@query("default_override")
def default_override(spark, sf):
    kept = _final(spark, sf).filter("outcome = 'valid'")
    forced = {n: _DEFAULTS[n] for n in V.OVERRIDABLE_FIELDS}
    return corrections.apply_overrides(kept, forced).select(*KEY, "surname", "postcode", "email")


@query("override_check")
def override_check(spark, sf):
    """Every member's postcode and email, taken as settings of one owner."""
    return corrections.checked_overrides(D.members(spark, sf).select("k", "postcode", "email"))


# --- logs and reports ------------------------------------------------------------

query("corrections_log")(lambda spark, sf: _auto_log(spark, sf).drop("field_pos"))
query("stats_total")(lambda spark, sf: report.stats_total(_auto_log(spark, sf)))
query("stats_by_type")(lambda spark, sf: report.stats_by_type(_auto_log(spark, sf)))
query("stats_by_field")(lambda spark, sf: report.stats_by_field(_auto_log(spark, sf)))
query("stats_all")(lambda spark, sf: report.stats_all(_auto_log(spark, sf)))
query("error_stats")(lambda spark, sf: report.error_stats(validate.error_table(_checked(spark, sf))))
query("summary")(lambda spark, sf: report.summary(report.tally(report.notes(_final(spark, sf)))))
query("skipped_list")(lambda spark, sf: report.skipped_list(_final(spark, sf).filter("outcome = 'skipped'")))
query("log_sorted")(lambda spark, sf: report.sorted_log(_auto_log(spark, sf)))
query("manual_log_sorted")(lambda spark, sf: report.sorted_manual_log(report.change_log(_final(spark, sf), ("patched",))))


@query("review_topk")
def review_topk(spark, sf):
    log = written(report.change_log(_fixed(spark, sf), ("fixes",)), "log")
    return report.review(log).withColumn("place", F.col("place").cast("long")).drop("field_pos")


@query("changes_union")
def changes_union(spark, sf):
    final = written(_final(spark, sf), "final")
    both = report.all_changes(report.change_log(final, ("fixes",)), report.change_log(final, ("patched",)))
    return both.groupBy("origin", "field").agg(F.count("*").alias("n"))


@query("mapping_report")
def mapping_report(spark, sf):
    headers = _written_headers(spark, sf)
    return align.mapping_report(headers, _mapping(spark, sf, headers))


@query("missing_report")
def missing_report(spark, sf):
    lists = _header_lists(spark, sf)
    return align.missing_report(written(_positions(spark, sf, lists), "positions"), lists).drop("field_pos")


@query("export_decision")
def export_decision(spark, sf):
    return report.export_decision(report.tally(report.notes(_final(spark, sf))), max_error_rate=0.5)


@query("full_run")
def full_run(spark, sf):
    """All stages from cells to the contract table."""
    answers = pipeline.Answers(decisions=D.decisions(spark, sf), patches=D.patches(spark, sf), skips=D.skips(spark, sf))
    return pipeline.clean_cells(D.cells(spark, sf), answers=answers).valid


@query("second_run")
def second_run(spark, sf):
    """The contract table of a run without answers, to which they are given afterwards."""
    first = pipeline.clean_cells(D.cells(spark, sf))
    fixes = pipeline.answered(first, pipeline.Answers(decisions=D.decisions(spark, sf)))
    return pipeline.answered(fixes, pipeline.Answers(patches=D.patches(spark, sf), skips=D.skips(spark, sf))).valid


@query("row_accounting")
def row_accounting(spark, sf):
    """Rows of every file, added up over all tables in which a run leaves them."""
    run = pipeline.clean_cells(D.cells(spark, sf))
    one = F.lit(1).cast("long").alias("n")
    parts = [t.select("file", one) for t in (run.final, run.widths, run.removed, run.bounds)]  # bounds: the header rows
    held = run.bounds.join(run.rejected.select("file"), "file", "left_semi")
    parts.append(held.select("file", (F.col("last_idx") - F.col("header_idx")).alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("file").agg(F.sum("n").alias("rows"))


def _ragged_run(spark, sf):
    """A run over rows of which some are too wide or too narrow, with texts given for a few."""
    rows = D.ragged(spark, sf).select(*KEY, "cells")
    heads = rows.groupBy("file").agg((F.min("row_idx") - 1).alias("row_idx")).withColumn("cells", F.array(*[F.lit(f.header) for f in CONTRACT]))
    given = D.skips(spark, sf).select(*KEY, F.lit("Asthma, mild").alias("text"))
    options = pipeline.Options(guard="parity", expected_width="contract", max_error_rate=0.8)
    return pipeline.clean_cells(rows.unionByName(heads), options, pipeline.Answers(medical=given))


query("summary_ragged")(lambda spark, sf: _ragged_run(spark, sf).summary())
query("export_decision_ragged")(lambda spark, sf: _ragged_run(spark, sf).export_decision())


@query("members_by_line")
def members_by_line(spark, sf):
    """Error counts over the larger table: one member per order line."""
    rows = validate.validate_table(normalize.normalize_table(D.line_members(spark, sf)), normalized=True)
    return report.error_stats(validate.error_table(rows))
