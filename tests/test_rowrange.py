"""Header and trailer detection on small sheets."""

import pytest
from pyspark.sql import functions as F

from musterroll.operators import rowrange as R

# Sheets are made from the edges of the rules: a header needs three known cells at any depth, or the look of
# one in the first twenty rows; data needs a share of 0.3 of its cells filled and no footer word.
TEN = ["email", "gender", "county", *["x"] * 7]


def filled(n, width=10):
    return ["qz"] * n + [""] * (width - n)


CASES = {
    "two known cells": ([["gender", "email", "qz"], ["va", "vb", "vc"]], (0, 1)),
    "two known cells lower down": ([["va", "vb", "vc"], ["gender", "email", "qz"], ["vd", "ve", "vf"]], (0, 2)),
    "three known cells": ([["va", "vb", "vc"], ["gender", "email", "county"], ["vd", "ve", "vf"]], (1, 2)),
    "known cells at any depth": ([["qz", "qy"]] * 40 + [["gender", "email", "county"], ["va", "vb", "vc"]], (40, 41)),
    "known beats the look": ([["Big Words", "More Words", "Last Words"], ["gender", "email", "county"], ["va", "vb", "vc"]], (1, 2)),
    "the look in row 19": ([["qz"]] * 19 + [["Big Words", "More Words", "Last Words"], ["va", "vb", "vc"]], (19, 20)),
    "the look in row 20": ([["qz"]] * 20 + [["Big Words", "More Words", "Last Words"], ["va", "vb", "vc"]], (0, 21)),
    "share at and below the edge": ([TEN, filled(10), filled(3), filled(2), filled(0)], (0, 2)),
    "nothing but sparse rows": ([TEN, filled(2), filled(1)], (0, 0)),
    "blank rows inside": ([TEN, filled(9), filled(0), filled(0), filled(4), filled(0)], (0, 4)),
    "footer words inside and after": ([TEN, filled(5), ["average", *filled(9, 9)], filled(6), ["a footer", *filled(5, 9)]], (0, 3)),
    "five numbers and four": ([["gender", "email", "county", "x", "x"], ["1", "2", "3", "4", ""], ["1", "£2", "3,000", "4", "5"]], (0, 1)),
    "no row below": ([["gender", "email", "county"]], (0, 0)),
    "no filled cell": ([filled(0), filled(0)], (0, 0)),
    "rows without cells": ([[], TEN, filled(7), []], (1, 2)),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, i, r) for name, (sheet, _) in CASES.items() for i, r in enumerate(sheet)]
    cells = spark.createDataFrame(rows, "file string, row_idx bigint, cells array<string>")
    return cells, {r.file: (r.header_idx, r.last_idx) for r in R.detect_range(cells).collect()}


@pytest.mark.parametrize("name", CASES)
def test_bounds(found, name):
    assert found[1][name] == CASES[name][1]


def test_trim_keeps_rows_between(found):
    cells, _ = found
    kept = R.trim_rows(cells, R.detect_range(cells)).filter("file = 'three known cells'").orderBy("row_idx").collect()
    assert [(r.row_idx, r.data_idx) for r in kept] == [(2, 0)]


def test_preview_shows_ends(found):
    cells, _ = found
    shown = R.trim_preview(cells, R.detect_range(cells)).filter("file = 'known cells at any depth'").orderBy("row_no").collect()
    assert [(r.side, r.row_no) for r in shown] == [("top", i) for i in range(1, 6)]
    assert shown[0].preview == "qz | qy"


def test_keyword_inside_words(spark):
    df = spark.createDataFrame([(["West county", "x"],), (["Total", "2"],)], "cells array<string>")
    got = df.select(R.has_summary_word(F.col("cells")).alias("a"), R.has_summary_word(F.col("cells"), "word").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, False), (True, True)]
