"""The parsers and the feature job against the same rules written in plain Python."""

import calendar
from datetime import date, timedelta

from hypothesis import given, settings, strategies as st

from sentimill import (
    build_features,
    default_releases,
    parse_quoted_lines,
    parse_review_lines,
    parse_training_lines,
)
from sentimill.functions.dates import MONTHS
from sentimill.operators.releases import DEFAULT_RELEASES

RELEASES = [date(int(y), int(m), int(d)) for m, d, y in (w.split("/") for w in DEFAULT_RELEASES.split())]
CONTROLS = "".join(map(chr, range(33)))


def fields(line, separator, n):
    parts = line.split(separator)
    if len(parts) > 1:
        while parts and parts[-1] == "":
            parts.pop()
    return parts if len(parts) >= n else None


def integer(text):
    digits = text[1:] if text[:1] in ("+", "-") else text
    if not digits or any(c not in "0123456789" for c in digits):
        return None
    return int(text) if -(2**31) <= int(text) < 2**31 else None


def day_of(text):
    month, _, rest = (text[:1].upper() + text[1:]).partition(" ")
    day, _, year = rest.partition(" ")
    plain = set("0123456789")
    if month not in MONTHS.split() or len(day) != 2 or len(year) != 4 or not set(day + year) <= plain:
        return None
    m, d, y = MONTHS.split().index(month) + 1, int(day), int(year)
    if not (1 <= d <= 31 and y >= 1):
        return None
    return date(y, m, min(d, calendar.monthrange(y, m)[1]))


def features(line):
    parts = fields(line, ",", 4)
    if parts is None:
        return None
    day_text, version, rating_text, body = (p.strip(CONTROLS) for p in parts[:4])
    day, rating = day_of(day_text), integer(rating_text)
    same_year = [r for r in RELEASES if day and r.year == day.year]
    if not body or rating is None or not same_year:
        return None
    after = any(r <= day <= r + timedelta(days=7) for r in same_year)
    return (body, after, version, int(rating >= 3))


pad = st.sampled_from(["", "", "", " ", "\t", "\r", "\x01 ", "\xa0"])
days = st.one_of(
    st.builds(
        "{} {} {}".format,
        st.sampled_from([*MONTHS.split(), "mar", "MAR", "nov", "Sept"]),
        st.sampled_from(["01", "13", "15", "20", "21", "28", "29", "30", "31", "32", "00", "4"]),
        st.sampled_from(["2008", "2012", "2015", "2016", "2017", "2018", "0000", "16"]),
    ),
    st.sampled_from(["", "x", "2016-03-13"]),
)
ratings = st.sampled_from(["1", "2", "3", "5", "-1", "+4", "4.5", "", "x", "99999999999", "07"])
bodies = st.sampled_from(["ok", "a, b", "", ",", ", x", 'say "hi"', "ünï", " "])


def padded(inner):
    return st.builds(lambda a, x, b: a + x + b, pad, inner, pad)


review = st.builds(
    lambda *parts: ",".join(parts),
    padded(days), padded(st.sampled_from(["1.0", "", "2"])), padded(ratings), padded(bodies),
)
soup = st.lists(st.sampled_from(["a", "b c", ",", ",,", '"', '","', " ", "true", "1", "é"]), max_size=12).map("".join)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(review, review, soup), min_size=30, max_size=60))
def test_features(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    got = rows(build_features(frame, default_releases(spark), on_error="drop"))
    assert got == sorted(f for f in map(features, texts) if f)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(review, soup), min_size=30, max_size=60))
def test_parsers(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    quoted = [p for t in texts if (p := fields(t, '","', 4))]
    assert rows(parse_quoted_lines(frame, on_error="drop")) == sorted((p[2], p[1], p[3]) for p in quoted)

    split = [p for t in texts if (p := fields(t, ",", 4))]
    trimmed = [[x.strip(CONTROLS) for x in p[:4]] for p in split]
    assert rows(parse_review_lines(frame, on_error="drop")) == sorted(
        (d, b, r, v) for d, v, r, b in trimmed
    )

    training = []
    for p in split:
        try:
            label = float(p[3].strip(CONTROLS))
        except ValueError:
            continue
        training.append((p[0], p[1].lower() == "true", p[2], label))
    assert rows(parse_training_lines(frame, on_error="drop")) == sorted(training)
