from datetime import date

import pytest
from pyspark.sql import functions as F

from exactdiff.functions.checks import CHECKS, checked, pair_tags
from exactdiff.functions.dates import calendar_date
from exactdiff.functions.text import first_difference, number

#: check, two texts for which it holds, two for which it does not
CASES = [
    ("trim", ("a", " a "), ("a", "b ")), ("case", ("Ab", "aB"), ("a", "a ")), ("trim+case", (" Ab", "ab"), ("ab", "ac")),
    ("num", ("1", " 1.0"), ("1", "1d")), ("num", ("1e2", "100"), ("", "0")), ("num", (".5", "0.50"), ("nan", "nan ")), ("num", ("+3", "3."), ("1_0", "10")),
    ("ws", ("a\tb", "c"), ("a b", "c")), ("date", ("2020-01-31", "31JAN2020"), ("01/02/2020", "2020-01-02")), ("date", ("01/01/2020", "2020-01-01"), ("2020-02-30", "20200230")),
    ("date", ("jan2020", "2020-01-01"), ("2020-01-01", "2020-01-02")), ("date", ("31dec1999:23:59:59", "1999-12-31"), ("31dec1999:24:00:00", "1999-12-31")),
    ("money", ("$1,000.00", "1000"), ("1", "1.0")), ("money", ("€ 5", "5"), ("$", "0")), ("pct", ("5%", "0.05"), ("5", "5.0")), ("pct", ("5 %", "5%"), ("5%", "5")),
    ("idpad", ("007", "7"), ("7a", "07a")), ("idpad", ("0" * 30 + "12345678901234567890123", "12345678901234567890123"), ("12345678901234567890123", "12345678901234567890124")),
    ("bool", ("Y", "no"), ("Y", "")), ("acctneg", ("(5.0)", "-5"), ("-5", "-5.0")), ("acctneg", (" ( 5 ) ", "-5.0"), ("(x)", "-x")),
    ("xlsdate", ("44927", "2023-01-01"), ("2023-01-01", "20230101")), ("xlsdate", ("00044927", "2023-01-01"), ("100000", "2173-10-14")),
    ("inws", ("a  b", "a b"), ("ab", "a b")), ("dash", ("a–b", "a-b"), ("a_b", "a-b")), ("fold", ("Café", "Cafe"), ("Cafe", "cafe")), ("fold", ("１ﬁ", "1fi"), ("a", "b")),
]


@pytest.mark.parametrize("name, good, bad", CASES)
def test_checks(spark, name, good, bad):
    found = checked(spark.createDataFrame([(0, *good), (1, *bad)], "i int, val_a string, val_b string"), names=[name]).orderBy("i").collect()
    assert [r[f"check_{name}"] for r in found] == [True, False]


def test_blank_is_never_a_number(spark):
    row = checked(spark.createDataFrame([("", "0")], "val_a string, val_b string")).first()
    assert not any(row[f"check_{k}"] for k in ("num", "bool", "money", "pct", "idpad", "date", "xlsdate", "acctneg"))


DATES = {
    "2020-02-29": date(2020, 2, 29), "2021-02-29": None, "01/02/2020": None, "02/02/2020": date(2020, 2, 2), "13/02/2020": date(2020, 2, 13), "1/5/2024": None, "20240105": date(2024, 1, 5),
    "1234": date(2034, 12, 1), "0169": date(1969, 1, 1), "0168": date(2068, 1, 1), "15JAN70": date(1970, 1, 15), "05JAN70": None, "5JAN2020": None, "05-Mar-2020": date(2020, 3, 5), "0000-01-01": None, "2020-01-01T23:59:59": date(2020, 1, 1),
    "2020-01-01T23:59:61": None, "": None, "MAR21": date(2021, 3, 1), "01012020": date(2020, 1, 1),
}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "x string").select("x", calendar_date(F.col("x")).alias("d"))
    assert {r.x: r.d for r in df.collect()} == DATES


def test_pair_tags(spark):
    df = spark.createDataFrame([("a", " A"), ("a", "a "), ("x", "y")], "val_a string, val_b string")
    assert [r.tags for r in pair_tags(df).collect()] == [["trim+case"], ["trim"], []]


def test_first_difference(spark):
    cases = {("abc", "abd"): 2, ("", "x"): 0, ("ab", "abc"): 2, ("😀a", "😀b"): 1, ("x" * 5000 + "a", "x" * 5000 + "b"): 5000}
    df = spark.createDataFrame(list(cases), "a string, b string").select("a", "b", first_difference(F.col("a"), F.col("b")).alias("d"))
    assert {(r.a, r.b): r.d for r in df.collect()} == cases


def test_number_guard(spark):
    df = spark.createDataFrame([("1f",), ("inf",), ("0x1",), ("1e400",), ("--1",)], "x string").select(number(F.col("x")).alias("n"))
    assert [r.n for r in df.collect()] == [None, None, None, float("inf"), None]


def test_every_check_is_native(spark):
    plan = checked(spark.createDataFrame([("a", "b")], "val_a string, val_b string"))._jdf.queryExecution().executedPlan().toString()
    assert len(CHECKS) == 15 and "Python" not in plan


def test_month_names_are_replaced_once_a_text(spark):
    names = {"FEBMAR": "2003-02-01", "JAN70": "1970-01-01", "janFEBmarapr": "0304-02-01", "01jan2020:10:11:12": "2020-01-01", "2020-01-02T03:04:05": "2020-01-02", "$1234.56": None}
    df = spark.createDataFrame([(k,) for k in names], "x string").select("x", calendar_date(F.col("x")).cast("string").alias("d"))
    assert {r.x: r.d for r in df.collect()} == names
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 12  # once for each name
