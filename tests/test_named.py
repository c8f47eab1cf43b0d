"""Files written under their own names, as one commit."""

import csv
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from musterroll.contract import HEADERS, NAMES
from musterroll.sources import folder, named

SCHEMA = "name string, part bigint, place bigint, content string"


def write(spark, rows, path, header=""):
    named.write_named(spark.createDataFrame(rows, SCHEMA), str(path), header)


def test_pieces_come_together_in_order(spark, tmp_path):
    rows = [(f"in/{n}.csv", n % 2, k, f"{n} {k}\n") for n in range(30) for k in range(40)]
    rows += [("empty.XLSX", 0, 0, ""), ("null.csv", 0, 0, None)]
    write(spark, rows[::-1], tmp_path / "o", "H\n")
    found = {r.name: r for r in named.manifest(spark, str(tmp_path / "o")).collect()}
    assert len(found) == 32
    for n in range(30):
        r = found[f"in/{n}.csv"]
        raw = Path(r.output.removeprefix("file://")).read_bytes()
        assert raw == ("H\n" + "".join(f"{n} {k}\n" for k in range(40))).encode()
        assert (r.part, r.rows, r.bytes, r.sha256) == (n % 2, 40, len(raw), hashlib.sha256(raw).hexdigest())
    assert Path(found["empty.XLSX"].output.removeprefix("file://")).read_bytes() == b"H\n"
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if not p.name.startswith(".")) == ["_SUCCESS", "_staged", "data", "manifest"]
    assert list((tmp_path / "o/_staged").iterdir()) == []


def test_a_failed_task_leaves_nothing_and_a_rerun_is_whole(spark, tmp_path):
    fail = F.udf(lambda k: 1 // (k - 700), "bigint")
    rows = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("name"), F.lit(0).alias("part"), F.col("id").alias("place"), F.lit("x").alias("content"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        named.write_named(rows.withColumn("content", fail("place").cast("string")), str(tmp_path / "o"))
    with pytest.raises(named.NotCommitted):
        named.manifest(spark, str(tmp_path / "o"))
    assert not list((tmp_path / "o").rglob("f*"))
    (tmp_path / "o/data/old").mkdir(parents=True)  # moved by a driver that was killed before it was done
    (tmp_path / "o/data/old/f1-0.csv").write_text("half")
    (tmp_path / "o/manifest").mkdir()
    (tmp_path / "o/manifest/old.json").write_text('{"name": "f1", "part": 0, "output": "data/old/f1-0.csv", "rows": 1, "bytes": 4, "sha256": ""}')
    named.write_named(rows, str(tmp_path / "o"))
    found = named.manifest(spark, str(tmp_path / "o")).collect()
    assert sorted(r.name for r in found) == [f"f{i}" for i in range(7)] and sum(r.rows for r in found) == 1000
    assert len([p for p in (tmp_path / "o/data").rglob("*") if p.is_file() and not p.name.startswith(".")]) == 7
    with pytest.raises(named.AlreadyCommitted):
        named.write_named(rows, str(tmp_path / "o"))


def test_an_attempt_that_does_not_count_is_dropped(spark, tmp_path):
    import pyarrow as pa

    writer = named._Writer(f"file://{tmp_path}/o", b"")
    batch = pa.record_batch([["a.csv"], [0], [b"one"]], names=["name", "part", "content"])
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.folder != second.folder
    writer.commit([second, named.Written("none", 0)])
    assert [r.output.split("/")[-2] for r in named.manifest(spark, str(tmp_path / "o")).collect()] == [second.folder]
    assert len(list((tmp_path / "o/data").rglob("a-*.csv"))) == 1


@pytest.mark.parametrize("name", ["x" * 400 + ".csv", "d/" * 300 + "a.csv", "é\U0001f600" * 200, "a b?*:<>|.xls", "..", ".hidden", "_secret", "a." + "e" * 300, ""])
def test_any_name_gives_a_safe_one(spark, tmp_path, name):
    other = named.output_name(name + "!", 0)
    out = named.output_name(name, 0)
    assert out != other and out != named.output_name(name, 1)
    assert len(out.encode()) <= 255 and out[0] not in "._" and "/" not in out


def test_contract_by_file(spark, tmp_path):
    long = "file:///in/" + "x" * 300 + ".csv"
    rows = [(f, i, *[f"{f[-5:]} {i} {j}" if j else 'a "b"\r\nc, d' for j in range(len(NAMES))]) for f, n in ((long, 3), ("file:///in/b.csv", 2)) for i in range(n)]
    rows.append(("file:///in/b.csv", 1 << 20, *["far"] * len(NAMES)))
    df = spark.createDataFrame(rows, "file string, row_idx bigint, " + ", ".join(f"{n} string" for n in NAMES))
    folder.write_contract_by_file(df, str(tmp_path / "o"))
    listed = named.manifest(spark, str(tmp_path / "o")).orderBy("name", "part").collect()
    assert [(r.name, r.part, r.rows) for r in listed] == [("file:///in/b.csv", 0, 2), ("file:///in/b.csv", 1, 1), (long, 0, 3)]
    with open(listed[2].output.removeprefix("file://"), newline="", encoding="utf-8") as f:
        assert list(csv.reader(f)) == [HEADERS, *[list(r[2:]) for r in rows[:3]]]
    back = folder.read_contract(spark, str(tmp_path / "o"), by_file=True)
    assert {(r.file, *[r[n] for n in NAMES]) for r in back.collect()} == {(r[0], *[v.replace("\r\n", "\n") for v in r[2:]]) for r in rows}  # Spark's reader joins line ends
    with pytest.raises(folder.NothingToWrite):
        folder.write_contract_by_file(df.limit(0), str(tmp_path / "p"))


def test_sink_guard_gives_the_sink_rows_that_are_checked_already(spark, tmp_path, monkeypatch):
    from musterroll.plans.queries import CATALOGUE

    people = [(k, f"Customer {k}", k % 2, "BUILDING") for k in range(1, 400)]
    spark.createDataFrame(people, "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "PERU"), (1, "CHINA")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    given, write = [], folder.write_contract_by_file
    monkeypatch.setattr(folder, "write_contract_by_file", lambda valid, path: (given.append(valid), write(valid, path)))
    rows = CATALOGUE["sink_guard"](spark, str(tmp_path)).collect()
    # No rule is worked out again, let alone in a filter over the scan of the input.
    assert "RLIKE" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.valid_rows for r in rows) == given[0].count() > 0 and len(rows) == 6
    assert all(r.refused == (r.valid_rows == 0) for r in rows)
