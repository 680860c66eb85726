import pytest
from pyspark.sql import functions as F

from sentimill import (
    equals_ignore_case,
    leading_fields,
    parse_double,
    parse_int,
    raw_review_date,
    raw_review_hour,
    release_date,
    review_date,
    trim_controls,
)


def evaluate(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.sort("i").select(make(F.col("v"))).collect()]


def trailing_empties_dropped(line, separator, n):
    """The field rule said another way: split, drop empty fields at the end, take n."""
    fields = line.split(separator)
    if len(fields) > 1:
        while fields and fields[-1] == "":
            fields.pop()
    return fields[:n] if len(fields) >= n else None


LINES = [
    "", ",", ",,,,", "a", "a,b,c", "a,b,c,d", "a,b,c,d,e", "a,b,c,", "a,b,c,,", "a,b,c,,,",
    "a,b,c,,e", "a,b,c, ", ",,,d", "a,,,", "a,,,,,,,z", "d,v,r, body, more", "a,b,c,d,,,,",
]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_leading_fields_comma(spark, n):
    want = [trailing_empties_dropped(line, ",", n) for line in LINES]
    # One field of an all-separator line does not exist; an empty line has one.
    got = evaluate(spark, LINES, lambda v: leading_fields(v, ",", n))
    if n == 1:
        want[0] = None  # an empty first field is never needed on its own
    assert got == want


QUOTED = [
    '"1","d","t","s","u"', '"1","d","t","s"', '"1","d","t"', '"1","d","t","', '"1","d","t","","',
    '"1","d","t","","u"', 'x","","y","z', 'x","," ', 'x",","', '"1","d","a, b, c","s"',
    'a","","","","","b', 'a",",",",","b',
]


def test_leading_fields_quoted(spark):
    want = [trailing_empties_dropped(line, '","', 4) for line in QUOTED]
    assert evaluate(spark, QUOTED, lambda v: leading_fields(v, '","', 4)) == want


def test_trim_controls(spark):
    values = ["\x00 a b\r\t", "\x1f\x20x\x7f ", " x ", "  \r", ""]
    want = ["a b", "x\x7f", " x ", "", ""]
    assert evaluate(spark, values, trim_controls) == want


def test_equals_ignore_case(spark):
    values = ["Neutral", "POSITIVE", "positive ", "positive\n", "negative", "", None]
    want = [True, True, False, False, False, False, None]
    assert evaluate(spark, values, lambda v: equals_ignore_case(v, "neutral", "positive")) == want


def test_parse_int(spark):
    values = ["4", "+4", "-4", "007", "4.5", "", " 4", "4\x7f", "x", "2147483648", "1e1", "4\n"]
    want = [4, 4, -4, 7, None, None, None, None, None, None, None, None]
    assert evaluate(spark, values, parse_int) == want


def test_parse_double(spark):
    values = ["1", " 1.5\r", "1e3", "2d", "x", "", "inf", "nan", "Infinity", "infinity", "-Infinity"]
    inf = float("inf")
    want = [1.0, 1.5, 1000.0, 2.0, None, None, None, None, inf, None, -inf]
    assert evaluate(spark, values, parse_double) == want
    assert evaluate(spark, ["NaN", "1e999"], parse_double)[0] != 0
    assert evaluate(spark, ["1e999"], parse_double) == [inf]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mar 13 2016", "2016-03-13"),
        ("mar 13 2016", "2016-03-13"),
        ("dec 01 2008", "2008-12-01"),
        ("Feb 29 2016", "2016-02-29"),
        ("Feb 29 2015", "2015-02-28"),
        ("Feb 30 2016", "2016-02-29"),
        ("Apr 31 2016", "2016-04-30"),
        ("MAR 13 2016", None),
        ("mAr 13 2016", None),
        ("Mar 4 2016", None),
        ("Mar 00 2016", None),
        ("Mar 32 2016", None),
        ("Mar 13 0000", None),
        ("Mar 13 16", None),
        ("March 13 2016", None),
        ("Mar 13 2016 ", None),
        ("anF 13 2016", None),
        ("", None),
        ("bad date", None),
    ],
)
def test_review_date(spark, text, want):
    got = evaluate(spark, [text], lambda v: review_date(v).cast("string"))
    assert got == [want]


def test_every_month(spark):
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    got = evaluate(spark, [f"{m} 15 2017" for m in months], lambda v: F.month(review_date(v)))
    assert got == list(range(1, 13))


def test_raw_review_time(spark):
    values = ["25/8/2016 08:49:14", "1/12/2016 22:00:00", "30/2/2016 10:00:00", "1/1/2016 24:00:00", "x"]
    days = evaluate(spark, values, lambda v: raw_review_date(v).cast("string"))
    assert days == ["2016-08-25", "2016-12-01", "2016-02-29", None, None]
    assert evaluate(spark, values, raw_review_hour)[:2] == [8, 22]


def test_release_date(spark):
    values = ["3/13/2008", "03/01/2009", "2/30/2015", "13/1/2008", "0/1/2008", "1/32/2008", "1/1/08", ""]
    got = evaluate(spark, values, lambda v: release_date(v).cast("string"))
    assert got == ["2008-03-13", "2009-03-01", "2015-02-28", None, None, None, None, None]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_results_do_not_depend_on_ansi_mode(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert evaluate(spark, ["4", "4.5", "x"], parse_int) == [4, None, None]
        assert evaluate(spark, ["a,b", "a,b,c,d"], lambda v: leading_fields(v, ",", 4)) == [
            None,
            ["a", "b", "c", "d"],
        ]
        dates = evaluate(spark, ["Feb 30 2016", "x"], lambda v: review_date(v).cast("string"))
        assert dates == ["2016-02-29", None]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
