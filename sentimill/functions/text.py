"""Column expressions for the text rules the record formats rely on.

All of them are built-in JVM expressions. A result of null means "malformed".
"""

import re

from pyspark.sql import Column, functions as F

# Trimming removes every character up to and including the space.
TRIMMED = "".join(map(chr, range(0x21)))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_controls(value) -> Column:
    """Trim control characters and spaces; SQL ``trim`` knows only the space."""
    return F.btrim(_col(value), F.lit(TRIMMED))


def leading_fields(line, separator: str, n: int) -> Column:
    """The first ``n`` fields of a separated line, or null when there are fewer.

    Empty fields at the very end of a line do not count as fields. The limit
    keeps the rest of a long line in one piece instead of splitting all of it.
    """
    quoted = re.escape(separator)
    parts = F.split(_col(line), quoted, n + 1)
    nth, rest = F.get(parts, F.lit(n - 1)), F.get(parts, F.lit(n))
    rest_has_text = F.coalesce(~rest.rlike(rf"^(?:{quoted})*\z"), F.lit(False))
    return F.when((nth != "") | rest_has_text, F.slice(parts, 1, n))


def equals_ignore_case(value, *words: str) -> Column:
    """Case-insensitive comparison with any of ``words`` (no trimming)."""
    choice = "|".join(re.escape(w) for w in words)
    return _col(value).rlike(rf"(?iu)^(?:{choice})\z")


def parse_int(value) -> Column:
    """Plain decimal 32-bit integer text; ``4.5``, blanks and overflow give null."""
    value = _col(value)
    return F.when(value.rlike(r"^[+-]?[0-9]+\z"), value.try_cast("int"))


def parse_double(value) -> Column:
    """Floating point text. ``NaN`` and ``Infinity`` only in exactly this spelling."""
    text = trim_controls(value)
    number = text.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    # Whatever is not finite is a spelled-out word or digits that overflow.
    spelled = text.rlike(r"^[+-]?(?:NaN|Infinity)\z") | ~text.rlike(r"(?i)[in][nai]")
    return F.when(finite | spelled, number)


def null_as_word(value) -> Column:
    """Text of a value, with null spelled ``null``."""
    return F.coalesce(_col(value).cast("string"), F.lit("null"))
