"""Whole runs on small folders, in the shapes the job is meant for."""

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from musterroll.contract import HEADERS, NAMES
from musterroll.operators import corrections, normalize, report, validate
from musterroll.plans import pipeline
from musterroll.plans.pipeline import Answers, Options
from musterroll.sources import folder

HEAD = ",".join(HEADERS)
# A member whose every field is in order and as short as may be; other rows say only what differs.
PLAIN = {"first_name": "Quill", "surname": "Tern", "gender": "Other", "classified_as_disabled": "No", "date_of_birth": "09/10/1993", "postcode": "ZE2 9XX", "email": "q@tern.net"}


def member(**changes):
    """A line of text; a value with a comma is quoted, a list is written as that many cells."""
    cells = []
    for name in NAMES:
        value = changes.get(name, PLAIN.get(name, ""))
        cells += value if isinstance(value, list) else [f'"{value}"' if "," in value else value]
    return ",".join(cells)


GOOD = [member(first_name="Ann", medical_conditions="wool, mild"), member(first_name="Ben", surname="Baker", school_year="4", course_id="77")]
ERRORS = [
    member(phone_number="555x5550100"),  # one open error
    member(gender="other", classified_as_disabled="NO", date_of_birth="1993-10-09", postcode="ze29xx", email="Q@tern.net"),  # five values to normalise
    member(gender="m", date_of_birth="10/25/1993"),  # two suggested fixes
    member(first_name="", school_year="99", email="none"),  # three open errors
    member(classified_as_disabled="Sometimes", date_of_birth="someday"),  # two open errors
]
SPLIT = [
    member(first_name="Kit", medical_conditions=["pollen", "latex"], address1="31 Skerry Way"),
    member(first_name="Rui", medical_conditions=["wool", "dust", "iodine", "noise"], address1="2 Voe Road"),
]
KEY = "file string, row_idx bigint"


@pytest.fixture
def run(spark, tmp_path):
    def go(files, options=Options(), **answers):
        for name, lines in files.items():
            (tmp_path / name).write_text("\n".join(lines) + "\n")
        made = {k: v(tmp_path) for k, v in answers.items()}
        return pipeline.clean_folder(spark, str(tmp_path), options, Answers(**made))

    return go


def test_valid_file(run):
    r = run({"a.csv": [HEAD, *GOOD]})
    assert r.valid.count() == 2 and r.quarantine.isEmpty() and r.automatic_log.isEmpty() and r.rejected.isEmpty()


def test_file_with_errors(run, spark):
    r = run({"a.csv": [HEAD, *ERRORS]})
    types = {x.type: x.n for x in report.stats_by_type(r.automatic_log).collect()}
    assert types == {"normalization": 5, "us_to_uk_date": 1, "gender_abbreviation": 1}
    per_row = {x.row_idx: x["count"] for x in validate.error_table(r.final).groupBy("row_idx").count().collect()}
    assert per_row == {1: 1, 4: 3, 5: 2}
    assert r.valid.count() == 2 and r.quarantine.count() == 3
    s = r.summary().first()
    assert (s["rows"], s.skipped, s.automatic, s.comma_repairs, s.manual) == (5, 0, 7, 0, 0)


def test_extra_rows_are_cut(run):
    blank = "," * (len(HEADERS) - 1)
    r = run({"a.csv": ["tides", blank, "moon,sun", HEAD, *GOOD, "footer", blank]})
    b = r.bounds.first()
    assert (b.header_idx, b.last_idx) == (3, 5) and r.valid.count() == 2
    assert [(x.row_idx, x.side, x.reason) for x in r.removed.orderBy("row_idx").collect()] == [
        (0, "top", "outside the data"), (1, "top", "empty"), (2, "top", "outside the data"), (6, "bottom", "footer word"), (7, "bottom", "empty"),
    ]


def test_a_member_who_looks_like_a_footer_is_kept_for_review(run):
    r = run({"a.csv": [HEAD, GOOD[0], GOOD[1].replace("Baker", "Sumner")]})
    assert r.valid.count() == 1 and [x.cells[2] for x in r.removed.collect()] == ["Sumner"]


def test_split_cells_are_joined(run):
    r = run({"a.csv": [HEAD, *SPLIT]})
    assert {x.medical_conditions for x in r.valid.collect()} == {"pollen, latex", "wool, dust, iodine, noise"}
    assert r.summary().first().comma_repairs == 2


def test_parity_guard_repairs_none(run):
    r = run({"a.csv": [HEAD, *SPLIT]}, Options(guard="parity"))
    assert r.valid.isEmpty() and {x.reason for x in r.quarantine.collect()} == {"unsafe_merge"}


def test_given_medical_text_repairs(run, spark):
    given = lambda d: spark.createDataFrame([(f"file://{d}/a.csv", 1, "Dust, mild")], KEY + ", text string")
    r = run({"a.csv": [HEAD, *SPLIT]}, Options(guard="parity"), medical=given)
    assert [x.medical_conditions for x in r.valid.collect()] == ["Dust, mild"] and r.quarantine.count() == 1
    assert [(x.field, x.original, x.corrected) for x in r.manual_log.collect()] == [("MedicalConditions", "pollen, latex", "Dust, mild")]
    s = r.summary().first()
    assert (s["rows"], s.skipped, s.comma_repairs, s.manual) == (2, 1, 1, 1)


def test_rows_of_wrong_width_count_as_bad(run):
    r = run({"a.csv": [HEAD, GOOD[0], *["a,b,c"] * 9]}, Options(max_error_rate=0.5))
    d = r.export_decision().first()
    assert (d["rows"], d.bad_rows, d.decision) == (10, 9, "too many errors") and r.valid.isEmpty()


SHORT = [h for h in HEADERS if h not in ("Sport Passport ID", "Postcode*", "Email*")]
SHORT_ROW = ",".join({**PLAIN, "county": "Shetland", "school_year": "6"}.get(n, "") for n, h in zip(NAMES, HEADERS) if h in SHORT)


def test_missing_required_columns(run):
    r = run({"a.csv": [",".join(SHORT), SHORT_ROW]})
    assert [x.reason for x in r.rejected.collect()] == ["Missing mandatory field: Postcode"] and r.valid.isEmpty()


def test_missing_columns_with_defaults(run):
    r = run({"a.csv": [",".join(SHORT), SHORT_ROW]}, Options(overrides={"postcode": "sw1a1aa", "email": "Office@Club.org"}))
    x = r.valid.first()
    assert (x.postcode, x.email, x.sport_passport_id) == ("SW1A 1AA", "office@club.org", "")


def test_fixed_width_sends_short_rows_away(run):
    o = Options(overrides={"postcode": "SW1A 1AA", "email": "a@b.co"}, expected_width="contract")
    r = run({"a.csv": [",".join(SHORT), SHORT_ROW]}, o)
    assert r.valid.isEmpty() and r.quarantine.first().reason == "too_few"


def test_bad_override_is_refused(run):
    for bad in ({"postcode": "nowhere"}, {"post_code": "SW1A 1AA"}, {"classified_as_disabled": "No"}):
        with pytest.raises(pipeline.BadOverride):
            run({"a.csv": [HEAD, *GOOD]}, Options(overrides=bad))


def test_a_declined_default_rejects_the_file(run, spark):
    head = HEAD.replace("ClassifiedAsDisabled*", "Extra")
    declined = lambda d: spark.createDataFrame([(f"file://{d}/a.csv", "classified_as_disabled", False)], "file string, field string, accept boolean")
    assert run({"a.csv": [head, *GOOD]}).valid.count() == 2
    assert [x.reason for x in run({"a.csv": [head, *GOOD]}, defaults=declined).rejected.collect()] == ["Missing mandatory field: ClassifiedAsDisabled"]


def test_spelling_of_headers(run):
    head = HEAD.replace("First Name*", "Forename").replace("DateOfBirth*", "DOB").replace("Postcode*", "post_code").replace("Email*", "E-Mail Address").replace("ClassifiedAsDisabled*", "Notes")
    r = run({"a.csv": [head, *GOOD]})
    assert r.valid.count() == 2 and {x.classified_as_disabled for x in r.valid.collect()} == {"No"}
    assert {x.how for x in r.mapping.collect()} == {"exact", "scored"}
    rejected = run({"a.csv": [head, *GOOD]}, Options(accept_scored=False)).rejected
    assert rejected.first().reason == "Missing mandatory field: First Name"


def test_answers_of_people(run, spark):
    f = lambda d: f"file://{d}/a.csv"
    cell = KEY + ", field string, value string"
    r = run(
        {"a.csv": [HEAD, *ERRORS]},
        patches=lambda d: spark.createDataFrame([(f(d), 1, "phone_number", "07811000000"), (f(d), 2, "surname", "Ignored"), (f(d), 4, "email", "a@b.org"), (f(d), 4, "email", "z@b.org")], cell),
        skips=lambda d: spark.createDataFrame([(f(d), 5)], KEY),
        decisions=lambda d: spark.createDataFrame([(f(d), 3, "gender", False)], KEY + ", field string, accept boolean"),
    )
    assert {x.row_idx: x.outcome for x in r.final.collect()} == {1: "valid", 2: "valid", 3: "quarantine", 4: "quarantine", 5: "skipped"}
    assert [(x.field, x.original, x.corrected) for x in r.manual_log.collect()] == [("PhoneNumber", "555x5550100", "07811000000")]
    assert [(x.row_idx, x["values"]) for x in r.patch_conflicts.collect()] == [(4, ["a@b.org", "z@b.org"])]
    checked = run({"a.csv": [HEAD, *ERRORS]}, Options(revalidate=True), patches=lambda d: spark.createDataFrame([(f(d), 1, "phone_number", "12")], cell))
    assert {x.row_idx: x.outcome for x in checked.final.collect()}[1] == "quarantine"


def test_error_rate_holds_files_back(run):
    r = run({"a.csv": [HEAD, *ERRORS], "b.csv": [HEAD, *GOOD]}, Options(max_error_rate=0.5))
    assert {x.file[-5:]: x.decision for x in r.export_decision().collect()} == {"a.csv": "too many errors", "b.csv": "export"}
    assert r.valid.count() == 2


def test_reports_come_from_one_read_of_the_rows(run, spark):
    f = lambda d: f"file://{d}/a.csv"
    r = run(
        {"a.csv": [HEAD, *ERRORS, *SPLIT, "a,b"], "b.csv": [HEAD, *GOOD]},
        patches=lambda d: spark.createDataFrame([(f(d), 1, "phone_number", "07811000000")], KEY + ", field string, value string"),
        skips=lambda d: spark.createDataFrame([(f(d), 5), (f(d), 7)], KEY),
    )
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(r.automatic_log) == as_rows(report.change_log(r.final)) != []
    assert as_rows(r.manual_log) == as_rows(report.change_log(r.final, ("patched",))) != []
    assert as_rows(report.noted_errors(r.notes)) == as_rows(validate.error_table(r.final)) != []
    assert r.notes.filter("first").count() == r.final.count() + r.widths.count() == 10
    counts = {x.file[-5:]: (x["rows"], x.valid_rows, x.bad_rows, x.skipped, x.comma_repairs) for x in r.tally.collect()}
    assert counts == {"a.csv": (8, 4, 2, 3, 2), "b.csv": (2, 2, 0, 0, 0)}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for made in (r.log, report.noted_errors(r.notes), r.summary(), r.export_decision()):
        assert "/final-" not in plan(made)
    for kept in (r.valid, r.quarantine):  # the other outcomes are not opened
        assert "PartitionFilters: [isnotnull(outcome" in plan(kept)


def test_write_result_and_second_run(run, spark, tmp_path_factory):
    """A run without a valid row writes all reports; its answers make the next run write the file."""
    out = str(tmp_path_factory.mktemp("out"))
    with pytest.raises(folder.NothingToWrite):
        pipeline.write_result(run({"a.csv": [HEAD, ERRORS[0]], "note.txt": ["x"]}), f"{out}/1")
    read = lambda name, n=1: spark.read.parquet(f"{out}/{n}/{name}")
    bad = read("quarantine").first()
    assert [e.field for e in bad.errors] == ["phone_number"] and read("rejected_files").count() == 1
    for name in ("removed_rows", "bounds", "removed_preview", "mapping", "open_choices", "missing_columns", "changes", "stats", "examples", "errors", "skipped", "patch_conflicts", "export_decision", "summary"):
        read(name).count()
    answer = spark.createDataFrame([(bad.file, bad.row_idx, "phone_number", "07811000000")], KEY + ", field string, value string")
    second = run({"a.csv": [HEAD, ERRORS[0], GOOD[0], GOOD[1]]}, patches=lambda d: answer)
    pipeline.write_result(second, f"{out}/2", by_file=True)
    parts = list(Path(f"{out}/2/valid/data").rglob("a-*.csv"))
    assert len(parts) == 1
    with open(parts[0], newline="", encoding="utf-8") as f:
        rows = list(csv.reader(f))
    assert rows[0] == HEADERS and [x[1] for x in rows[1:]] == ["Quill", "Ann", "Ben"]


def test_later_answers_give_what_a_whole_run_gives(run, spark):
    """Answers in three rounds, about rows and about files, against one run with all that hold."""
    head = HEAD.replace("ClassifiedAsDisabled*", "Extra")
    files = {"a.csv": [HEAD, *ERRORS, *SPLIT, "a,b"], "b.csv": [HEAD, *GOOD, "Total: 2"], "c.csv": [head, *GOOD], "d.csv": [HEAD, *GOOD]}
    o = Options(guard="parity")
    first = run(files, o)
    f = lambda name: first.bounds.filter(F.col("file").endswith(name)).first().file
    a = f("a.csv")
    cell = KEY + ", field string, value string"
    patch = lambda *rows: spark.createDataFrame([(a, *r) for r in rows], cell)
    skip = lambda *rows: spark.createDataFrame(list(rows), KEY)
    range_ = spark.createDataFrame([(f("b.csv"), 0, 1)], "file string, header_idx bigint, last_idx bigint")
    medical = spark.createDataFrame([(a, 6, "Dust, mild")], KEY + ", text string")
    declined = spark.createDataFrame([(f("c.csv"), "classified_as_disabled", False)], "file string, field string, accept boolean")
    second = pipeline.answered(first, Answers(patches=patch((1, "phone_number", "1"), (4, "email", "a@b.org")), skips=skip((a, 5), ("none", 1))))
    third = pipeline.answered(second, Answers(patches=patch((1, "phone_number", "07811000000")), skips=skip((f("b.csv"), 1)), medical=medical, ranges=range_, defaults=declined))
    whole = pipeline.clean_cells(
        first.cells, o,
        Answers(patches=patch((1, "phone_number", "07811000000"), (4, "email", "a@b.org")), skips=skip((a, 5), ("none", 1), (f("b.csv"), 1)), medical=medical, ranges=range_, defaults=declined),
    )
    as_rows = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    for name in ("final", "widths", "bounds", "mapping", "positions", "removed", "valid", "quarantine", "manual_log", "patch_conflicts"):
        assert as_rows(getattr(third, name)) == as_rows(getattr(whole, name)), name
    assert as_rows(third.rejected) == as_rows(whole.rejected) != as_rows(first.rejected)
    assert as_rows(third.summary()) == as_rows(whole.summary()) != as_rows(second.summary())
    assert {r.file for r in second.redone.collect()} == {a} and {r.file[-5:] for r in third.redone.collect()} == {"a.csv", "b.csv", "c.csv"}
    same = pipeline.answered(first, Answers())
    assert same.redone is None and same.final is first.final


def test_every_row_of_every_file_is_accounted_for(run, spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes((HEAD + "\n,Jos\u00e9,Sol\n").encode("latin-1"))
    (tmp_path / "broken.xlsx").write_bytes(b"PK not a workbook")
    (tmp_path / "open.csv").write_text(HEAD + '\n,"' + "x" * 140_000 + "\n" + "y\n" * 50)
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text(HEAD + "\n")
    (tmp_path / "head and foot.csv").write_text(HEAD + "\nTotal,0\n\n")
    (tmp_path / "other head.csv").write_text("gender,email,county\n")
    r = run({"a.csv": [HEAD, *ERRORS, *SPLIT, "a,b", "Total: 9"], "blank.csv": ["", "x,y", "z,w"]})
    reasons = {x.file.rsplit("/", 1)[1]: x.reason for x in r.rejected.collect()}
    assert reasons.keys() == {"latin.csv", "broken.xlsx", "open.csv", "none.csv", "blank.csv", "head.csv", "head%20and%20foot.csv", "other%20head.csv"}
    assert {reasons[f] for f in reasons if "head" in f} == {reasons["none.csv"]} == {"No data found"}
    assert r.rejected.count() == len(reasons)  # one reason each
    assert reasons["latin.csv"] == "Not UTF-8 text" and "Unreadable workbook" in reasons["broken.xlsx"] and "unclosed quote" in reasons["open.csv"]
    kept = r.final.count() + r.widths.count()
    assert kept + r.removed.filter("file like '%/a.csv'").count() + 1 == len(ERRORS) + len(SPLIT) + 3


def test_every_row_has_one_outcome_and_log_replays(spark):
    """Over a hot file with a third of the rows: nothing lost, log explains all changes."""
    rows = [("hot" if i % 3 == 0 else f"f{i % 50}", i, *[["  jo ", "AB", "m", "yes", "", "2001-06-05", "e19br", "7.9"][(i * 7 + j) % 8] for j in range(20)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "file string, row_idx bigint, " + ", ".join(f"{n} string" for n in NAMES))
    checked = validate.validate_table(normalize.normalize_table(df))
    final = pipeline.apply_answers(checked, Options(), Answers(skips=df.filter("row_idx % 10 = 0").select("file", "row_idx")))
    per = {r.outcome: r["count"] for r in final.groupBy("outcome").count().collect()}
    assert sum(per.values()) == 3000 and per["skipped"] == 300
    one = validate.error_table(checked).groupBy("file", "row_idx", "field").count().filter("count > 1")
    assert one.isEmpty()
    trimmed = df.select("file", "row_idx", *[F.trim(F.col(n)).alias(n) for n in NAMES])
    log = report.change_log(checked, ("changes",))
    before = trimmed.select("file", "row_idx", F.posexplode(F.array(*NAMES)).alias("field_pos", "was"))
    after = checked.select("file", "row_idx", F.posexplode(F.array(*NAMES)).alias("field_pos", "now"))
    replay = before.join(log, ["file", "row_idx", "field_pos"], "left").withColumn("now", F.coalesce("corrected", "was"))
    assert replay.select("file", "row_idx", "field_pos", "now").exceptAll(after).isEmpty()


def test_top_k_of_a_hot_group(spark):
    log = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("type"),
        F.lit("f").alias("file"), (4999 - F.col("id")).alias("row_idx"), F.lit(1).alias("field_pos"),
    )
    top = report.review(log).filter("type = 'a'").orderBy("place").collect()
    want = sorted(4999 - i for i in range(0, 5000, 3))[:10]
    assert [r.row_idx for r in top] == want and top[0].type_total == 1667 and top[0].more == 1657


def test_overrides_table(spark):
    df = spark.createDataFrame([(1, "sw1a1aa", "A@B.co"), (2, "bad", "x"), (3, " ", None)], "owner int, postcode string, email string")
    got = {r.owner: (r.postcode, r.email, r.postcode_ok, r.email_ok) for r in corrections.checked_overrides(df).collect()}
    assert got == {1: ("SW1A 1AA", "a@b.co", True, True), 2: (None, None, False, False), 3: (None, None, True, True)}
