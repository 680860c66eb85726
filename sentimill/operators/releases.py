"""Release calendar and the after-release flag."""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import release_date
from ..functions.policy import check_policy, settle

# The default release calendar, month/day/year.
DEFAULT_RELEASES = """
3/13/2008 5/22/2008 8/21/2008 11/13/2008
3/12/2009 5/21/2009 8/27/2009 11/12/2009
3/13/2010 5/22/2010 8/21/2010 11/13/2010
3/12/2011 5/21/2011 8/27/2011 11/12/2011
3/13/2012 5/22/2012 8/21/2012 11/13/2012
3/13/2013 5/22/2013 8/21/2013 11/13/2013
3/13/2014 5/22/2014 8/21/2014 11/13/2014
3/12/2015 5/21/2015 8/27/2015 11/12/2015
3/13/2016 5/22/2016 8/21/2016 11/13/2016
3/12/2017 5/21/2017 8/27/2017 11/12/2017
"""

# Fixed value: a review counts as "after release" up to this many days later.
WINDOW_DAYS = 7


def release_calendar(spark: SparkSession, dates: list[date]) -> DataFrame:
    """A calendar from dates known in the program: one column ``release``."""
    return spark.range(1, numPartitions=1).select(F.explode(F.lit(dates)).alias("release"))


def default_releases(spark: SparkSession) -> DataFrame:
    """The default calendar: 40 releases, four a year, 2008 to 2017."""
    months_days_years = [map(int, word.split("/")) for word in DEFAULT_RELEASES.split()]
    return release_calendar(spark, [date(y, m, d) for m, d, y in months_days_years])


def read_releases(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Calendar from text files with one ``M/d/yyyy`` date per line; blank lines are skipped (S3)."""
    check_policy(on_error, ("fail", "drop"))
    text = F.trim("value")
    releases = spark.read.text(path).filter(text != "").select(release_date(text).alias("release"), "value")
    return settle(releases, [("release", "not a M/d/yyyy release date", "value")], on_error).select("release")


def releases_by_year(releases: DataFrame) -> DataFrame:
    """``year, releases``: the release dates of each year, sorted, each once (A3).

    A group holds at most 366 dates however long or repetitive the calendar is:
    equal dates are combined before the shuffle.
    """
    year = F.year("release")
    in_range = releases.select(F.when(year.between(1, 9999), year).alias("year"), "release", year.alias("_year"))
    return (
        settle(in_range, [("year", "release year outside 1-9999", "_year")], "fail")
        .groupBy("year")
        .agg(F.sort_array(F.collect_set("release")).alias("releases"))
    )


def release_days(releases: DataFrame) -> DataFrame:
    """``day, in_window`` for every day of every year that has releases.

    Turning the range test into one row per day makes the lookup below a plain
    equi-join. A window ends with its year. Size: at most 366 rows a year and
    9,999 years, whatever the size of the calendar.
    """
    days = releases_by_year(releases).select(
        "releases",
        F.explode(
            F.sequence(
                F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
            )
        ).alias("day"),
    )
    in_window = F.exists(
        "releases", lambda r: F.col("day").between(r, F.date_add(r, WINDOW_DAYS))
    )
    return days.select("day", in_window.alias("in_window"))


def with_after_release(
    df: DataFrame,
    releases: DataFrame,
    day: Column | str = "date",
    name: str = "afterRelease",
    on_error: str = "fail",
) -> DataFrame:
    """Add ``name``: is ``day`` on a release date or up to seven days after it (J1)?

    Only releases of the same calendar year count. A day in a year without any
    release is an error, not false. The day table is broadcast: its size is
    bounded by the range of dates, so the large side is never shuffled and its
    skew does not matter.
    """
    check_policy(on_error)
    day = F.col(day) if isinstance(day, str) else day
    keyed = df.withColumn("_day", day.cast("date"))
    days = F.broadcast(
        release_days(releases).select(F.col("day").alias("_day"), F.col("in_window").alias("_in"))
    )
    flagged = settle(
        keyed.join(days, "_day", "left"), [("_in", "no releases known for the year of", "_day")], on_error
    )
    return flagged.withColumn(name, F.col("_in")).drop("_day", "_in")
