"""File scans against the standard library's reader, and the sink round trip."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from musterroll import runtime
from musterroll.contract import HEADERS, NAMES
from musterroll.sources import delimited, folder, workbook


def scanned(spark, path, glob="*.csv"):
    out = {}
    for r in delimited.scan_delimited(spark, str(path), glob).collect():
        out.setdefault(r.file.rsplit("/", 1)[1], {})[r.row_idx] = r.cells
    for rows in out.values():
        assert sorted(rows) == list(range(len(rows)))
    return {f: [rows[i] for i in range(len(rows))] for f, rows in out.items()}


def by_library(path):
    with open(path, encoding="utf-8-sig") as f:
        return list(csv.reader(f))


TEXTS = {
    "plain.csv": "a,b,c\n1,2\n\n,,\n x ,y\n",
    "quoted.csv": 'a,"b, c",d\n"say ""hi""",,"""x"""\n"",b\n"a"b,c"d,"e"\n',
    "breaks.csv": 'a,"line one\nline two",c\nnext,row\n"x\n\n""y"",z",2\nlast,"open',
    "bom.csv": "﻿a,b\n1,2\n",
    "windows.csv": 'a,b\r\n"c\r\nd",e\r\n',
    "noend.csv": "a,b\n1,2",
}


def test_rows_agree_with_library(spark, tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
    got = scanned(spark, tmp_path)
    for name in TEXTS:
        assert got[name] == by_library(tmp_path / name), name


def test_random_files_over_many_splits(spark, tmp_path):
    """Small splits, so that quoted cells and records cross their borders."""
    rng = random.Random(7)
    words = ["a", "b,c", 'q"q', "two\nlines", "", "long " * 10, "x\n\ny", '"']
    for i in range(4):
        with open(tmp_path / f"r{i}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            for _ in range(400):
                out.writerow([rng.choice(words) for _ in range(rng.randint(1, 5))])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = delimited.read_lines(spark, str(tmp_path))
        assert lines.select("file", "split").distinct().count() > 20
        got = scanned(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for i in range(4):
        assert got[f"r{i}.csv"] == by_library(tmp_path / f"r{i}.csv")


def test_long_quoted_cells_do_not_overflow(spark):
    text = '"' + 'x""y,' * 50000 + '",end'
    row = spark.createDataFrame([(text,)], "t string").select(delimited.split_cells(F.col("t")).alias("c")).first()
    assert row.c == next(csv.reader(io.StringIO(text))) if len(text) < 131072 else (len(row.c) == 2 and row.c[1] == "end")


def test_dispatch_and_rejections(spark, tmp_path):
    (tmp_path / "a b.CSV").write_text("x,y\n1,2\n")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "empty.csv").write_text("")
    rows = folder.scan_folder(spark, str(tmp_path)).cells
    assert rows.count() == 2
    lost = folder.rejected_files(folder.list_files(spark, str(tmp_path)), rows.select("file").distinct()).collect()
    assert {r.file.rsplit("/", 1)[1]: r.reason for r in lost} == {"b.txt": "Unsupported file format: .txt", "empty.csv": "No data found"}


def _book(rows_xml, strings=(), styles=""):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" r:id="r7"/></sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r7" Target="/xl/worksheets/data.xml"/></Relationships>',
        )
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')
        z.writestr("xl/worksheets/data.xml", f'<worksheet xmlns="{main}"><sheetData>{rows_xml}</sheetData></worksheet>')
    return out.getvalue()


def test_workbook_cells_become_text(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs>'
    xml = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="3"><c r="A3"><v>9</v></c><c r="B3"><v>7.5</v></c><c r="C3" s="1"><v>37241</v></c><c r="D3" s="2"><v>37241.5</v></c><c r="E3" t="b"><v>1</v></c></row>'
        '<row r="5"><c r="A5"/></row>'
    )
    (tmp_path / "a.xlsx").write_bytes(_book(xml, ("Name", "Born"), styles))
    rows = workbook.scan_workbooks(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r.cells for r in rows] == [
        ["Name", "", "Born", "", ""], [""] * 5, ["9", "7.5", "2001-12-16 00:00:00", "2001-12-16 12:00:00", "True"],
    ]


def test_sink_quotes_everything(spark, tmp_path):
    row = ["", 'say "hi"', "a,b", "two\nlines"] + [None] * 16
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{n} string" for n in NAMES))
    folder.write_contract(df, str(tmp_path / "out"), single_file=True)
    part = next((tmp_path / "out").glob("part-*"))
    with open(part, newline="", encoding="utf-8") as f:
        text = f.read()
    want = io.StringIO()
    csv.writer(want, quoting=csv.QUOTE_ALL).writerows([HEADERS, [x or "" for x in row]])
    assert text == want.getvalue()
    assert list(folder.read_contract(spark, str(tmp_path / "out")).first()) == [x or "" for x in row]


def test_sink_refuses_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], ", ".join(f"{n} string" for n in NAMES))
    with pytest.raises(folder.NothingToWrite):
        folder.write_contract(empty, str(tmp_path / "out"))


def test_splits_may_change_between_plan_and_run(spark, tmp_path):
    """Positions come from lines that were written, so no later split setting can lose one."""
    (tmp_path / "a.csv").write_text("".join(f"r{i},x\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = delimited.scan_delimited(spark, str(tmp_path))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        places = rows.agg(F.count_distinct("row_idx").alias("n"), F.max("row_idx").alias("last"), F.count_if(F.col("cells")[0] == F.concat(F.lit("r"), F.col("row_idx"))).alias("right")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (places.n, places.last, places.right) == (20_000, 19_999, 20_000)


def test_shared_folder_or_an_error(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(runtime.NoSharedFolder):
        runtime.shared_dir(Session())
    monkeypatch.setattr(Context, "getCheckpointDir", lambda self: "hdfs:///x/")
    assert runtime.shared_dir(Session()) == "hdfs:///x"


@pytest.mark.parametrize("parts", [1, 5])
def test_no_plan_shuffles_text(spark, tmp_path, monkeypatch, parts):
    """Whatever the broadcast threshold, and however many parts the facts of the splits are cut in."""
    for n in range(6):
        (tmp_path / f"{n}.csv").write_text(("\ufeff" if n % 2 else "") + "".join(f"{n} {i},x\n" for i in range(3000 * n + 1)))
    (tmp_path / "latin.csv").write_bytes(b"\xe9,x\n")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    if parts > 1:
        tasks = delimited.read_lines(spark, str(tmp_path)).rdd.getNumPartitions()
        monkeypatch.setattr(delimited, "BROADCAST_BYTES", -(-tasks * delimited.SPLITS_A_TASK * delimited.FACT_BYTES // parts))
        assert delimited.parts_of(delimited.read_lines(spark, str(tmp_path))) == parts
    try:
        scan = delimited.read_delimited(spark, str(tmp_path))
        plan = scan.cells._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and (parts > 1 or "BroadcastHashJoin" in plan)
        places = scan.cells.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("row_idx").alias("d"), F.max("row_idx").alias("last"), F.count_if(F.col("cells")[0].endswith(F.concat(F.lit(" "), F.col("row_idx")))).alias("good"))
        got = {r.file[-5]: (r.n, r.d, r.last + 1, r.good) for r in places.collect()}
        assert got == {str(n): (3000 * n + 1,) * 4 for n in range(6)}
        assert [r.file[-9:] for r in scan.rejected.collect()] == ["latin.csv"]
    finally:
        for key in settings:
            spark.conf.unset(key)
