"""What happens to a record that cannot be parsed.

``fail`` ends the job with an error, ``drop`` leaves the record out, and ``mark`` keeps it
with the rule it breaks in the column ``_rejected`` and its whole line in ``_line``, so that
one pass yields the good records, the bad ones and their numbers. A parser yields
null for a malformed value, and ``settle`` decides about its rows. The decision is a
condition on the row, so under ``fail`` a malformed record ends the job whichever columns
are read, and also when rows are only counted.
"""

from pyspark.sql import Column, DataFrame, functions as F

POLICIES = ("fail", "drop", "mark")

REASON, LINE = "_rejected", "_line"


def check_policy(on_error: str, allowed: tuple[str, ...] = POLICIES) -> None:
    if on_error not in allowed:
        raise ValueError(f"on_error must be one of {allowed}, not {on_error!r}")


def marks(df: DataFrame) -> list[str]:
    """The columns that ``mark`` has added, for operators that select theirs by name."""
    return [c for c in (REASON, LINE) if c in df.columns] if REASON in df.columns else []


def accepted(marked: DataFrame) -> DataFrame:
    """The records of a marked frame that break no rule, without the marks."""
    kept = computed_once(marked, F.col(REASON).isNull())
    return kept.drop(REASON, LINE)


def rejected(marked: DataFrame) -> DataFrame:
    """``reason, text`` of the records that break a rule."""
    bad = computed_once(marked, F.col(REASON).isNotNull())
    return bad.select(F.col(REASON).alias("reason"), F.col(LINE).alias("text"))


def rejections(marked: DataFrame) -> DataFrame:
    """``reason, n``: how many records break each rule."""
    return rejected(marked).groupBy("reason").agg(F.count("*").alias("n"))


def _error(what: str, source: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.substring(source, 1, 200), F.lit("null"))))


def checked(value: Column, what: str, source: Column, on_error: str) -> Column:
    """``value``, raising ``what`` with the source text when null under ``fail``.

    For single expressions: nothing is raised where nobody reads the value.
    """
    return value if on_error != "fail" else F.coalesce(value, _error(what, source))


def computed_once(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """The rows of ``df``, or those where ``keep`` is true, computed at this point.

    A filter over parsed columns would be pushed below the parsing, which then
    runs twice, once for the filter and once for the rows that pass it. Filters
    do not move below an ``inline``, and an unread column does not take the condition
    with it.
    """
    row = F.array(F.struct("*"))
    return df.select(F.inline(row if keep is None else F.when(keep, row)))


def settle(df: DataFrame, checks: list[tuple[str, str, str]], on_error: str) -> DataFrame:
    """The rows in which each checked column has a value, computed at this point.

    ``checks`` lists column, complaint and the column with the source text. A row
    without a value is left out, or ends the job with the first complaint, or is marked with it
    if it has no mark yet.
    """
    check_policy(on_error)
    if on_error == "mark":
        found = [F.when(F.col(column).isNull(), F.lit(what)) for column, what, _ in checks]
        earlier = F.col(REASON) if REASON in df.columns else F.lit(None).cast("string")
        return df.withColumn(REASON, F.coalesce(earlier, *found))
    keep = F.when(F.lit(False), F.lit(True))
    for column, what, source in checks:
        refused = F.lit(False) if on_error == "drop" else _error(what, F.col(source).cast("string")).cast("boolean")
        keep = keep.when(F.col(column).isNull(), refused)
    return computed_once(df, keep.otherwise(True))
