"""Accept and reject lists for single values, as tables of expected results."""

import datetime as dt

from pyspark.sql import functions as F

from musterroll import fixed_values as V
from musterroll.contract import BY_NAME, HEADERS, NAMES, OUTPUT_SCHEMA, WIDTH
from musterroll.functions import checks, dates, text as X
from musterroll.operators import align, normalize, ragged, validate


def normal(spark, field, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {field} string")
    return [r[field] for r in normalize.normalize_table(df, **kw).orderBy("i").collect()]


def errors(spark, field, values):
    """(message, suggestion) per value, or None."""
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], f"file string, row_idx bigint, {field} string")
    rows = validate.validate_table(df).orderBy("row_idx").collect()
    out = []
    for r in rows:
        hit = [e for e in r.errors if e.field == field]
        out.append((hit[0].message, hit[0].suggested) if hit else None)
    return out


def test_contract_shape():
    assert WIDTH == 20 and len(set(NAMES)) == 20 and len(OUTPUT_SCHEMA) == 20
    assert NAMES[5] == "medical_conditions" and HEADERS[12] == "Postcode*"
    assert sum(f.required for f in BY_NAME.values()) == 7


def test_title_case_agrees_with_python(spark):
    words = ["o'brien", "MARY-JANE", "a1b x", "élan vital", "ÉCOLE", "van der berg", "d'arcy-SMITH"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.t for r in df.select(X.title(F.col("w")).alias("t")).collect()] == [w.title() for w in words]


def test_letter_tests_agree_with_python(spark):
    words = ["Abc", "ABC", "abc", "Abc Def", "ABc", "A1", "12", "O'Brien", "O'brien", "", "ÉCOLE", "a B"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    got = df.select("w", X.is_title(w).alias("t"), X.is_upper(w).alias("u"), X.is_single_case(w).alias("s")).collect()
    assert [(r.t, r.u, r.s) for r in got] == [(x.istitle(), x.isupper(), x.islower() or x.isupper()) for x in words]


def test_strip_agrees_with_python(spark):
    words = [" a ", "\ta\n", " a ", "a\x1f", "　", "", "a b", "​a", "x\ny", " \tx y "]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.t for r in df.select(X.strip(F.col("w")).alias("t")).collect()] == [w.strip() for w in words]


def test_numbers_agree_with_python(spark):
    words = ["1", "1.5", "1_000", "1e3", ".5", "5.", "1d", "1.5f", "", "abc", "1__0", "+7", "-3.9", "0x1", "1e", "_1"]

    def expected(w):
        try:
            return float(w)
        except ValueError:
            return None

    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.d for r in df.select(X.to_double(F.col("w")).alias("d")).collect()] == [expected(w) for w in words]


def test_names(spark):
    assert normal(spark, "first_name", ["  noor ", "PETRA", "MacLeod", "", None]) == ["Noor", "Petra", "MacLeod", "", ""]


def test_enums(spark):
    assert normal(spark, "gender", ["MALE", "female", "m", "x"]) == ["Male", "Female", "m", "x"]
    assert errors(spark, "gender", ["Male", "m", "FEMALE", "o", "x", ""]) == [
        None, (V.MSG_GENDER, "Male"), (V.MSG_GENDER, "Female"), (V.MSG_GENDER, "Other"),
        ("Must be one of: Male, Female, Other", None), ("Gender is required", None),
    ]
    assert errors(spark, "classified_as_disabled", ["Yes", "yes", "n"]) == [
        None, (V.MSG_CASE, "Yes"), ("Must be one of: Yes, No", None),
    ]


NBSP = "\u00a0"


def test_postcodes(spark):
    good = ["N1 4AG", "EH12 9NG", "W1T 3JH", "GL50 3LP", "B33 8TH", "CR2 6XH"]
    assert errors(spark, "postcode", good) == [None] * len(good)
    assert normal(spark, "postcode", ["n1 4ag", "eh129ng", f"w1t{NBSP}3jh\n", "N1", "gl50\t3lp"]) == ["N1 4AG", "EH12 9NG", "W1T 3JH", "N1", "GL50 3LP"]
    assert errors(spark, "postcode", ["n1 4ag", "EH129NG", "90210", "QWERT", "N1"]) == [
        (V.MSG_POSTCODE_FORMAT, "N1 4AG"), (V.MSG_POSTCODE_FORMAT, "EH12 9NG"),
        (V.MSG_POSTCODE, None), (V.MSG_POSTCODE, None), (V.MSG_POSTCODE, None),
    ]


def test_emails(spark):
    assert errors(spark, "email", ["q@r.st", "row.er@boat-club.org", "cox+8@river.co.uk", "q@r.st\n"]) == [None] * 4
    bad = ["nobody", "@r.st", "q.r.st", "two words@r.st", "q@r.s", "q@r.st\nx"]
    assert errors(spark, "email", bad) == [(V.MSG_EMAIL, None)] * 6
    assert normal(spark, "email", [" Q@R.St ", "q@r.st\r\n"]) == ["q@r.st", "q@r.st"]


def test_phones(spark):
    assert errors(spark, "phone_number", ["07811204516", "01632 960 001", "+44 (0)1632 960001", "", f"07811{NBSP}204516", "07811204516\n", "(01632) 96", "0163x960001"]) == [
        None, None, None, None, None, None, (V.MSG_PHONE_SHORT, None), (V.MSG_PHONE_CHARS, None),
    ]


def test_integers(spark):
    raw = ["6", "6.8", "3e0", "abc", "-0.4", "0012", "1_1", "9\n", "9999999999999999", "98765432109876543210", "-3e20"]
    assert normal(spark, "school_year", raw) == ["6", "6", "3", "abc", "0", "12", "11", "9", *[str(int(float(x))) for x in raw[8:]]]
    assert errors(spark, "school_year", ["1", "13", "13.9", "0", "0.9", "14", "x", "inf", "1e999"]) == [
        None, None, None, ("Value must be at least 1", None), ("Value must be at least 1", None),
        ("Value must be at most 13", None), (V.MSG_NUMBER, None), (V.MSG_NUMBER, None), (V.MSG_NUMBER, None),
    ]


def test_dates(spark):
    given = {
        "04/11/1998": "04/11/1998", "4/1/1998": "04/01/1998", "1998-11-24": "24/11/1998", "2002-05-03": "03/05/2002", "24-11-1998": "24/11/1998",
        "24 Nov 1998": "24/11/1998", "November 24, 1998": "24/11/1998", "19981124": "24/11/1998", "1998-11-24 00:00:00": "24/11/1998", "3.5.02": "03/05/2002",
        "24-Nov-98": "24/11/1998", "24 Nov 98": "24/11/1998", "24/Nov/1998": "24/11/1998", "24th of November 1998": "24/11/1998",
        "Tuesday 24 November 1998": "24/11/1998", "Tue, 24 Nov. 1998": "24/11/1998", "04/11/1998\n": "04/11/1998",
        "unknown": "unknown", "41/17/1998": "41/17/1998", "24 of": "24 of",
    }
    assert dict(zip(given, normal(spark, "date_of_birth", list(given)))) == given
    assert normal(spark, "date_of_birth", ["2002-05-03", "1998-11-24"], iso_dayfirst=True) == ["05/03/2002", "24/11/1998"]
    assert errors(spark, "date_of_birth", ["04/11/1998", "03/05/2002", "11/24/1998", "1/31/1998", "41/17/1998", "29/02/2003", "29/02/2004", "01/01/0000", "1998-11-24", "x"]) == [
        None, None, (V.MSG_DATE_US, "24/11/1998"), (V.MSG_DATE_US, "31/01/1998"), (V.MSG_DATE_RANGE, None), (V.MSG_DATE_RANGE, None),
        None, (V.MSG_DATE_RANGE, None), (V.MSG_DATE_CONVERT, "24/11/1998"), (V.MSG_DATE_BAD, None),
    ]


def test_patterns_end_at_the_very_end(spark):
    df = spark.createDataFrame([(v,) for v in ("N1 4AG", "N1 4AG\n", "N1 4AG\r\n", "N1 4AG\u2028")], "v string")
    assert [r.m for r in df.select(checks.matches(F.col("v"), V.POSTCODE_PATTERN).alias("m")).collect()] == [True, False, False, False]


def test_strip_cuts_every_blank_at_either_end(spark):
    words = [a + "a b" + z for a in ["", *X.BLANKS] for z in ["", *X.BLANKS, "\r\n"]]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.s for r in df.select(X.strip(F.col("w")).alias("s")).collect()] == [w.strip() for w in words]


def test_every_day_of_the_calendar_exists(spark):
    """The calendar pattern against the calendar itself, 1895 to 2105."""
    start, end = dt.date(1895, 1, 1), dt.date(2105, 12, 31)
    n = (end - start).days + 1
    real = spark.range(n).select(F.date_format(F.date_add(F.lit(start), F.col("id").cast("int")), "dd/MM/yyyy").alias("t"))
    every = (
        spark.range(1895, 2106).withColumnRenamed("id", "y")
        .select("y", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("m"))
        .select("y", "m", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("d"))
        .select(F.format_string("%02d/%02d/%04d", "d", "m", "y").alias("t"))
    )
    accepted = every.filter(dates.exists(F.col("t")))
    assert accepted.count() == n and accepted.exceptAll(real).isEmpty()


def test_typed_dates(spark):
    day = spark.createDataFrame([(1, dt.date(2001, 12, 16))], "i int, date_of_birth date")
    assert normalize.normalize_table(day).first().date_of_birth == "16/12/2001"
    serial = spark.createDataFrame([(1, 37241.0), (2, None), (3, float("nan"))], "row_idx int, date_of_birth double")
    assert [r.date_of_birth for r in normalize.normalize_table(serial).orderBy("row_idx").collect()] == ["16/12/2001", "", ""]
    hit = validate.validate_table(serial).orderBy("row_idx").first().errors
    assert [(e.message, e.suggested) for e in hit if e.field == "date_of_birth"] == [(V.MSG_DATE_CONVERT, "16/12/2001")]


def test_normalising_twice_changes_nothing(spark):
    values = ["  john ", "O'BRIEN", "7.9", "e1 9br", "2001-06-05", "1/2/2001", "MALE", "A@B.COM", "x", ""]
    rows = [tuple([i] + [values[(i + j) % len(values)] for j in range(20)]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_idx int, " + ", ".join(f"{n} string" for n in NAMES))
    once = normalize.normalize_table(df).drop("changes")
    twice = normalize.normalize_table(once)
    assert twice.filter(F.size("changes") > 0).isEmpty()
    assert twice.drop("changes").exceptAll(once).isEmpty()


def test_header_scores(spark):
    heads = ["First Name", "DOB", "Post Code", "E-mail", "Random Column", "Student First Name", "", "*", "Sex", "Given_Name"]
    df = spark.createDataFrame([("f", i, h) for i, h in enumerate(heads)], "file string, pos int, header string")
    best = {r.header: (r.field, round(r.score, 3)) for r in align.match_best(align.match_score(df)).collect()}
    assert best["First Name"] == ("first_name", 1.0) and best["DOB"] == ("date_of_birth", 1.0)
    assert best["Post Code"] == ("postcode", 1.0) and best["E-mail"] == ("email", 1.0) and best["Given_Name"] == ("first_name", 1.0)
    assert {"Random Column", "Student First Name", "", "*"}.isdisjoint(best)


def test_address_shapes(spark):
    yes = ["", "12 High Street", "old mill lane", "Flat 3", "unit 9 x"]
    no = ["16/12/1990", "Rose Cottage", "asthma"]
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    assert [r.a for r in df.select(ragged.looks_like_address(F.col("v")).alias("a")).collect()] == [True] * 5 + [False] * 3


def test_rules_work_on_a_stream(spark, tmp_path):
    """Normalising and checking are stateless, so a stream can use them."""
    src = str(tmp_path / "in")
    spark.createDataFrame([("f", 0, "m", "e1 9br")], "file string, row_idx bigint, gender string, postcode string").write.parquet(src)
    stream = spark.readStream.schema("file string, row_idx bigint, gender string, postcode string").parquet(src)
    out = validate.validate_table(normalize.normalize_table(stream)).select("postcode", F.size("errors").alias("n"))
    q = out.writeStream.format("memory").queryName("checked").trigger(availableNow=True).start()
    q.awaitTermination(120)
    row = spark.sql("SELECT * FROM checked").first()
    assert row.postcode == "E1 9BR" and row.n == 6


LAYOUTS = [
    "%b-%d-%Y", "%Y %B %d", "%Y-%b-%d", "%d %b, %Y", "%B %d %Y", "%b. %d, %Y", "%A, %d %B %Y", "%d %B %Y %A", "%Y %d %B", "%d %Y %b",
    "%Y-%m-%dT%H:%M:%S+01:00", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S.%f", "%I%p %d %B %Y", "%H:%M %d/%m/%Y", "%d %b %Y at %I:%M %p", "%H:%M:%S %b %d %Y UTC",
    "%d%b%Y", "%b%d,%Y", "%d-%b-%Y", "%a %b %d %Y", "the", "%Y %m %d", "%d/%m/%Y", "%d.%m.%Y", "%Y/%m/%d", "%Y%m%d", "%dth of %B, %Y", "%B %dth %Y", "%b'%d'%Y", "%d;%m;%Y",
]


def test_dates_in_any_order(spark):
    import datetime as dt
    import random

    rng, given = random.Random(1), {}
    for layout in LAYOUTS:
        for _ in range(12):
            day = dt.datetime(rng.randint(1900, 2040), rng.randint(1, 12), rng.randint(1, 28), rng.randint(1, 23), rng.randint(0, 59), rng.randint(0, 59))
            for text in {day.strftime(layout), day.strftime(layout).upper(), day.strftime(layout).replace(" 0", " ")}:
                given[text] = day.strftime("%d/%m/%Y") if layout != "the" else text
    given |= {
        "5 June 10": "05/06/2010", "June 5 10": "05/06/2010", "10 5 June": "05/06/2010", "99-Jun-05": "05/06/1999", "Jun 99 5": "05/06/1999", "13-31-2010": "13-31-2010",
        "2010 31 06": "2010 31 06", "31 June 2010": "31 June 2010", "29 Feb 2012": "29/02/2012", "29 Feb 2011": "29 Feb 2011", "0 June 2010": "0 June 2010",
        "June 5": "June 5", "June 2010": "June 2010", "2010": "2010", "16": "16", "5th": "5th", "June": "June", "10:30": "10:30", "Monday": "Monday", "5 June": "5 June",
        "5 June July 2010": "5 June July 2010", "5 June 2010 2011": "5 June 2010 2011", "5 June 2010 x": "5 June 2010 x", "x5 June 2010": "x5 June 2010", "5 Juneau 2010": "5 Juneau 2010",
        "5 June 20100": "5 June 20100", "5 June 201": "5 June 201", "5 -6 20": "05/06/2020", "10:30 11:30 5 June 2010": "10:30 11:30 5 June 2010", "Monday Tuesday 5 June 2010": "Monday Tuesday 5 June 2010",
        "25:00 5 June 2010": "25:00 5 June 2010", "5 June 2010 13:61": "5 June 2010 13:61", "c 5 June 2010": "c 5 June 2010", "m5 6 2010": "m5 6 2010", "mjune 5 2010": "mjune 5 2010", "w 5 6 2010": "w 5 6 2010",
    }
    assert dict(zip(given, normal(spark, "date_of_birth", list(given)))) == given
