"""Date rules of the two review layouts. A result of null means "malformed"."""

from pyspark.sql import Column, functions as F

from .text import _col

# English short month names in calendar order.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"


def capitalised(value) -> Column:
    """First character in upper case, the rest untouched."""
    value = _col(value)
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substr(value, F.lit(2)))


def _calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date from digits; a day past the end of its month means the month's last day.

    Null for a missing part, the year 0000, a month over 12, a day over 31 and for
    zeros. A cast from year-month-day text is much cheaper than a formatter run.
    """
    month_text = F.concat(year, F.lit("-"), month, F.lit("-"))
    date = F.concat(month_text, day).try_cast("date")
    last = F.last_day(F.concat(month_text, F.lit("1")).try_cast("date"))
    return F.when(year != "0000", F.coalesce(date, F.when(day.isin("29", "30", "31"), last)))


def _part(value: Column, separator: str, n: int) -> Column:
    return F.split_part(value, F.lit(separator), F.lit(n))


def review_date(value) -> Column:
    """``Mar 13 2016`` (first letter in either case, two-digit day) as a date."""
    value = _col(value)
    numbers = F.create_map(
        *[F.lit(x) for n, name in enumerate(MONTHS.split(), 1) for x in (name, str(n))]
    )
    month = F.try_element_at(numbers, capitalised(F.substring(value, 1, 3)))
    date = _calendar_date(F.substring(value, 8, 4), month, F.substring(value, 5, 2))
    return F.when(value.rlike(r"^.{3} [0-9]{2} [0-9]{4}\z"), date)


def release_date(value) -> Column:
    """``3/13/2008`` (month, day, year) as a date."""
    value = _col(value)
    date = _calendar_date(*(_part(value, "/", n) for n in (3, 1, 2)))
    return F.when(value.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"), date)


# Day and time of the raw review layout, e.g. ``25/8/2016 08:49:14``.
_RAW_SHAPE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"


def raw_review_date(value) -> Column:
    """Date part of ``25/8/2016 08:49:14`` (day, month, year)."""
    value = _col(value)
    day = F.substring_index(value, " ", 1)
    date = _calendar_date(*(_part(day, "/", n) for n in (3, 2, 1)))
    return F.when(value.rlike(_RAW_SHAPE), date)


def raw_review_hour(value) -> Column:
    """Hour of day of ``25/8/2016 08:49:14``, independent of any time zone."""
    value = _col(value)
    hour = F.substring(F.substring_index(value, " ", -1), 1, 2).try_cast("int")
    return F.when(value.rlike(_RAW_SHAPE), hour)
