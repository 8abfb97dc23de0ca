"""Scalar functions on hand rows (FIXTURES.md part C)."""

from pyspark.sql import functions as F

from readlens.functions import expr as X


def one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_trailing_year(spark):
    got = one(spark, ["Tue Mar 03 08:19:07 -0800 2015", "x", "", None,
                      "Tue Mar 03 08:19:07 -0800 0101", "12015", "Tue Mar 03 08:19:07 -0800 2015\n"],
              X.trailing_year)
    assert got == [2015, None, None, None, 101, 2015, 2015]


def test_month_abbrev(spark):
    got = one(spark, ["Tue Mar 03 08:19:07 -0800 2015", "Tue Foo 03 08:19:07 -0800 2015",
                      "Mar 03 2015", "Sun Dec 7 01:00:00 +0000 2014", None], X.month_abbrev_to_num)
    assert got == [3, None, None, 12, None]


def test_month_index_and_difference(spark):
    assert one(spark, [201503], X.month_index, "int") == [24182]
    df = spark.createDataFrame([(201601, 201512)], "a int, b int")
    assert df.select(X.months_between_idx("a", "b")).first()[0] == 1


def test_safe_int(spark):
    assert one(spark, ["2001", "", "20 01", None, "99999999999"], X.safe_int) == [2001, None, None, None, None]


def test_has_text(spark):
    assert one(spark, ["   ", "\t\n", None, "a"], X.has_text) == [False, True, False, True]


def test_share_zero_denominator(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a long, b long")
    assert [r[0] for r in df.select(X.share("a", "b")).collect()] == [None, 0.25]


def _py_year(s):
    import re

    m = re.search(r"(\d{4})$", s) if s is not None else None
    return int(m.group(1)) if m else None


def _py_month(s):
    import re

    m = re.match(r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+\d{1,2}\s", s) if s is not None else None
    if not m or m.group(1) not in X.MONTH_ABBREVIATIONS:
        return None
    return X.MONTH_ABBREVIATIONS.index(m.group(1)) + 1


def test_text_parsers_on_random_strings(spark):
    import random

    rnd = random.Random(11)
    words = ["Tue", "Mar", "Dec", "Jan", "Foo", "mar", "Sept", "1", "03", "123", "2015", "12015",
             "0101", "08:19:07", "-0800", "+0000", "x", ""]
    spaces = [" ", "  ", "\t", ""]
    values = [None]
    for _ in range(600):
        parts = [rnd.choice(words) for _ in range(rnd.randint(0, 7))]
        values.append("".join(p + rnd.choice(spaces) for p in parts).rstrip(rnd.choice(["", " "])))
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", X.trailing_year("v").alias("y"), X.month_abbrev_to_num("v").alias("m")).collect()
    for r in got:
        assert r.y == _py_year(r.v), r.v
        assert r.m == _py_month(r.v), r.v
