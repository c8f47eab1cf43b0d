"""Untidy member files derived from the supplied tables.

The supplied tables are clean, so dirt is put in by rule: ``k`` is the
customer key and each field takes value ``k % n`` of a list.  Files grow in
number with the table, and one file holds a third of all members, so that
every plan meets a very large group.

Only the derivation of members is written in SQL common to both engines; the
other tables are built here with DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll.contract import CONTRACT, HEADERS, NAMES
from musterroll.runtime import spread

ROWS_PER_FILE = 60
TOP_ROWS = ["Club register", "Exported for the membership team", ""]


def _pick(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


def _text(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


# Blanks that spreadsheets leave behind: at ends, and inside values.
NBSP = "\u00a0"
_PHONES = _text("07811204516", "01632 960 001", "(01632) 96", "0163x960001", "", f"07811{NBSP}204516", "07811204516\n")


def _member_fields(k: str, name: str, segment: str, nation: str) -> dict[str, str]:
    return {
        "sport_passport_id": "''",
        "first_name": _pick(k, _text("  noor ", "ANNE-LISE", "d'arcy", "Petra", "MacLeod", "", f"Tove{NBSP}")),
        "surname": _pick(k, [name, *_text("OKAFOR", "lund", "De Wit", "rao", "Byrne\n")]),
        "gender": _pick(k, _text("Male", "female", "M", "f", "o", "Unsaid", "", "OTHER", "Male\n")),
        "classified_as_disabled": _pick(k, _text("Yes", "no", "YES", "n", "", "Perhaps", "No\n")),
        "medical_conditions": _pick(k, _text("", "Pollen, latex", "Vertigo")),
        "date_of_birth": _pick(
            k,
            _text(
                "04/11/1998", "11/24/1998", "03/05/2002", "1998-11-24", "2002-05-03",
                "24-11-1998", "unknown", "41/17/1998", "", "04/11/1998\n",
                "24 Nov 1998", "7th of March 2004", "Sunday 3 May 2009", "9/Aug/2011", "5-Sep-03",
                "24/11/1998 10:30", "3rd of", "Jun-05-2010", "2010 June 5", "2010-06-05T10:00:00+01:00", "10am 5 June 2010",
            ),
        ),
        "address1": _pick(k, [*_text("83 Skerry Way"), segment, "''"]),
        "address2": _pick(k, [*_text("83 Skerry Way"), segment, "''"]),
        "phone_number": _pick(k, _PHONES),
        "town_city": nation,
        "county": "'Avon'",
        "postcode": _pick(k, _text("ab1 2cd", "EH12NG", "N1C 4AG", "NOPE", "", "gl50  3lp", f"W1T{NBSP}3JH", "N1C 4AG\n")),
        "country": "'England'",
        "emergency_contact_name": _pick(k, _text("Odd Larkin", "")),
        "emergency_contact_phone": _pick(f"({k} + 1)", _PHONES),
        "emergency_contact_phone2": _pick(f"({k} + 2)", _PHONES),
        "email": _pick(
            k,
            [f"concat('User', CAST({k} AS STRING), '@Example.com')", *_text("nobody@nowhere", "two words@x.org", "q@r.st", "", "q@r.st\n")],
        ),
        "school_year": _pick(k, _text("7", "7.9", "0", "14", "abc", "", "1e1", "13", "9\n", "98765432109876543210")),
        "course_id": _pick(k, _text("101", "5.0", "x", "", "9999999999999999")),
    }


def members_sql() -> str:
    """Members in SQL that both engines read alike; tables as {customer} and {nation}."""
    fields = _member_fields("k", "c_name", "c_mktsegment", "n_name")
    columns = ",\n  ".join(f"{expr} AS {name}" for name, expr in fields.items())
    return f"""
SELECT k, file_no,
  concat('members_', lpad(CAST(file_no AS STRING), 6, '0'), '.csv') AS file,
  CAST(file_no % 4 + 1 + place AS BIGINT) AS row_idx,
  {columns}
FROM (
  SELECT c_custkey AS k, c_name, c_mktsegment, n_name,
    CASE WHEN c_custkey % 3 = 0 THEN 0
         ELSE 1 + CAST(floor((c_custkey - floor(c_custkey / 3) - 1) / {ROWS_PER_FILE}) AS BIGINT) END AS file_no,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_custkey / 3) AS BIGINT)
         ELSE CAST(c_custkey - floor(c_custkey / 3) - 1 AS BIGINT) % {ROWS_PER_FILE} END AS place
  FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
) t"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return spark.sql(members_sql(), customer=spread(people), nation=table(spark, sf_dir, "nation"))


def line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger table for measurements: one member per order line."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("c_custkey"),
        F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("c_name"),
        (F.col("l_suppkey") % 25).cast("int").alias("c_nationkey"),
        F.col("l_returnflag").alias("c_mktsegment"),
    )
    return spark.sql(members_sql(), customer=spread(lines), nation=table(spark, sf_dir, "nation"))


# --- files: raw cells, with titles, headers and footers ---------------------

_LOOSE_HEADERS = [
    "Ref", "Student First Name", "Family Name", "Sex", "Health Notes", "Medical Info", "Birth Date",
    "Street Address", "Address Line Two", "Telephone", "City", "Region", "Post Code", "Nation",
    "Contact Name", "Emergency Tel", "Emergency Phone 2", "E-mail", "Year Group", "Course Code",
]


def _changed(changes: dict[str, str]) -> list[str]:
    return [changes.get(h, h) for h in HEADERS]


def header_variants() -> list[list[str]]:
    """Exact, unstarred, lower case, third spelling, loose, and with gaps."""
    return [
        HEADERS,
        [f.label for f in CONTRACT],
        [f.label.lower() for f in CONTRACT],
        [f.spellings[min(2, len(f.spellings) - 1)] for f in CONTRACT],
        _LOOSE_HEADERS,
        _changed({"Sport Passport ID": "", "ClassifiedAsDisabled*": "Notes", "Country": "County", "Email*": " Contact  E_Mail"}),
    ]


def unknown_headers() -> list[str]:
    """Headers no field answers to; only their look gives them away."""
    return [f"Column {chr(ord('A') + i)}" for i in range(len(HEADERS))]


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def header_cells(file_no: Column) -> Column:
    kind = file_no % len(header_variants())
    out = F.when(file_no % 7 == 5, _literal(unknown_headers()))
    for i, words in enumerate(header_variants()):
        out = out.when(kind == i, _literal(words))
    return out


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, row_idx, cells``: every row of every file, in file order."""
    people = members(spark, sf_dir)
    body = people.select("file", "row_idx", F.array(*NAMES).alias("cells"))
    per_file = people.groupBy("file", "file_no").agg(F.count("*").alias("n"))
    head = F.col("file_no") % 4
    blank = F.array_repeat(F.lit(""), 19)

    top = F.transform(
        F.slice(_literal(TOP_ROWS), F.lit(1), head.cast("int")),
        lambda text, i: F.struct(i.cast("long").alias("row_idx"), F.when(text == "", blank).otherwise(F.array(text)).alias("cells")),
    )
    header = F.array(F.struct(head.alias("row_idx"), header_cells(F.col("file_no")).alias("cells")))
    size = F.col("n").cast("string")
    total = F.array(F.concat(F.lit("Total: "), size, F.lit(" members")))
    spread = F.array(F.lit("Total"), size, F.lit("members"))
    closing = F.array(F.lit("Continued on sheet 2"), F.lit(""), F.lit(""))
    tail_rows = (
        F.when(F.col("file_no") % 3 == 1, F.array(total))
        .when(F.col("file_no") % 3 == 2, F.array(blank, spread, closing))
        .otherwise(F.array().cast("array<array<string>>"))
    )
    tail = F.transform(tail_rows, lambda c, i: F.struct((head + 1 + F.col("n") + i).alias("row_idx"), c.alias("cells")))
    frame = per_file.select("file", F.explode(F.concat(top, header, tail)).alias("r")).select(
        "file", F.col("r.row_idx").alias("row_idx"), F.col("r.cells").alias("cells")
    )
    return body.unionByName(frame)


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`members` as cells, some too wide and some too narrow."""
    people = members(spark, sf_dir)
    whole = F.array(*NAMES)
    extra = F.when(F.col("k") % 2 == 0, _literal(["Pollen", "latex", "iodine"])).otherwise(_literal(["Pollen", "latex"]))
    wide = F.concat(F.slice(whole, 1, 5), extra, F.slice(whole, 7, 14))
    short = F.slice(whole, 1, 19)
    shaped = F.when(F.col("k") % 11 == 0, wide).when(F.col("k") % 13 == 0, short).otherwise(whole)
    return people.select("k", "file", "row_idx", shaped.alias("cells"))


# --- answers given by people --------------------------------------------------

PATCH_VALUES = {
    "first_name": "Sam", "surname": "Field", "gender": "Female", "classified_as_disabled": "No",
    "date_of_birth": "01/02/2003", "phone_number": "07700900123", "postcode": "SW1A 1AA",
    "emergency_contact_phone": "07700900124", "emergency_contact_phone2": "07700900125",
    "school_year": "9", "course_id": "12",
}


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer that has orders, with its place in the files."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    people = members(spark, sf_dir).select("k", "file", "row_idx")
    return people.join(first, F.col("k") == F.col("o_custkey")).drop("o_custkey")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches for all fields of every second row, and some for single fields."""
    values = [F.struct(F.lit(n).alias("field"), F.lit(v).alias("value")) for n, v in PATCH_VALUES.items()]
    mail = F.struct(
        F.lit("email").alias("field"),
        F.concat(F.lit("fixed"), F.col("first_order").cast("string"), F.lit("@club.org")).alias("value"),
    )
    keys = _keys(spark, sf_dir)
    some = F.when(F.col("k") % 17 < 8, F.array(*values, mail)).otherwise(F.array(mail))
    return (
        keys.filter(F.col("k") % 17 < 12)
        .select("file", "row_idx", F.explode(some).alias("p"))
        .select("file", "row_idx", "p.field", "p.value")
    )


def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).filter(F.col("k") % 19 == 0).select("file", "row_idx")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir).filter(F.col("k") % 5 < 2)
    named = F.explode(_literal(["date_of_birth", "gender"])).alias("field")
    return keys.select("file", "row_idx", named, (F.col("k") % 5 == 0).alias("accept"))
