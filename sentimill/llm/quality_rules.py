"""Quality rules: a table of thresholds, compiled into one projection over the texts.

No user functions, no shuffle: every figure of a document is an expression over its own
text, and every rule is a comparison of two figures, so the filter is a single pass over
the rows whatever their number. Ratios are compared crosswise, in whole numbers.

Figures: the base ones of ``figures`` (words, their code points, symbols, repeated lines,
words in repeated windows), further ``n_marks`` (ASCII punctuation), ``n_worded``
(words with a letter), ``n_stop_words`` (of the lists below, without punctuation around
them), ``n_lines`` (lines with a word), ``n_bullet_lines`` and ``n_ellipsis_lines``.

A row of the table is a ``Rule``: ``percent_low <= 100 * figure / per <= percent_high``, from
``from_words`` words on. Most thresholds are those that were published for web text (word
length, symbols, words with letters, stop words, bullets, ellipses, repeated lines); the one on
all punctuation is ours.

Results for odd input: a null text has no words and fails the base rule of ten words, as do
empty and blank ones; a ratio whose ``per`` is zero breaks no rule; a null ``doc_id`` is
carried along; repeated rows are judged each for itself, and alike; an empty table gives no
rows; other columns may have any name. A very long text is one row's work: its windows are sorted
within the row.
"""

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LARGE, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 5

# The most frequent function words of four languages.
STOP_WORDS = """
the of and to a in is that it on was for with be as at by this are from have not or an
der die und in den von zu das mit sich des auf für ein ist im nicht eine dem als auch
de la le et les des en un du une est que par pour qui sur dans au pas il
de la que el en y los se del las un por con no una su para es al lo como
""".split()


@dataclass(frozen=True)
class Rule:
    """``percent_low <= 100 * figure / per <= percent_high``; a missing bound holds always."""

    name: str
    figure: str
    per: str
    percent_low: int | None = None
    percent_high: int | None = None
    from_words: int = 0


RULES = (
    Rule("word length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("punctuation", "n_marks", "n_words", None, 100),
    Rule("words with letters", "n_worded", "n_words", 80, None, 20),
    Rule("stop words", "n_stop_words", "n_words", 2, None, 100),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullets", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", None, 30),
)

# What a document must have, whatever the table says.
LEAST_WORDS, MOST_REPEATED = 10, 20

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_marks", "n_worded", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _without(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "")


def _count(items: Column, wanted) -> Column:
    return F.size(F.filter(items, wanted)).cast("long")


def _repeated_words(windows: str) -> Column:
    """Words in windows that are there twice or more; ``windows`` is sorted, by text and place."""
    w = F.col(windows)
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    places = F.zip_with(
        F.slice(w, F.lit(1), rest),
        F.slice(w, F.lit(2), rest),
        lambda a, b: F.when(a["text"] == b["text"], F.array(a["place"], b["place"])).otherwise(F.array().cast("array<int>")),
    )
    return F.sort_array(F.array_distinct(F.flatten(places)))


def _covered(places: str) -> Column:
    """How many words windows at the sorted ``places`` cover together."""
    p = F.col(places)
    steps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` as the struct ``row``, and the figures of each text beside it."""
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.translate(t, MARKS + LARGE, " " * len(MARKS) + SMALL)
    numbered = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    windows = F.transform(
        F.when(F.size("_words") >= WINDOW, numbered).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat_ws(" ", *[F.get("_words", i + k) for k in range(WINDOW)]).alias("text"), i.alias("place")),
    )
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole_text(f"`{text}`").alias("_text")).select(
        "row",
        "_text",
        F.filter(F.split(t, WHITE), lambda x: x != "").alias("_words"),
        lines.alias("_lines"),
        F.filter(F.split(bare, WHITE), lambda x: x.isin(STOP_WORDS)).alias("_stops"),
    )
    sorted_windows = split.withColumn("_windows", F.sort_array(windows))
    repeated = sorted_windows.withColumn("_places", _repeated_words("_windows"))
    n_lines = F.size("_lines").cast("long")
    return repeated.select(
        "row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _covered("_places").alias("n_repeat_words"),
        (F.length(t) - F.length(_without(t, MARKS))).cast("long").alias("n_marks"),
        _count(F.col("_words"), lambda x: x.rlike(r"\p{L}")).alias("n_worded"),
        F.size("_stops").cast("long").alias("n_stop_words"),
        n_lines.alias("n_lines"),
        _count(F.col("_lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
        _count(F.col("_lines"), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("n_ellipsis_lines"),
    )


def broken(rule: Rule) -> Column:
    """Does a document break ``rule``? Never null."""
    value, per = 100 * F.col(rule.figure), F.col(rule.per)
    outside = F.lit(False)
    if rule.percent_low is not None:
        outside = outside | (value < rule.percent_low * per)
    if rule.percent_high is not None:
        outside = outside | (value > rule.percent_high * per)
    return (per > 0) & (F.col("n_words") >= rule.from_words) & outside


def rules_of(table: DataFrame, most: int = 1_000) -> tuple[Rule, ...]:
    """The rules of a table with the columns of ``Rule``, of at most ``most`` rows; more are an error."""
    rows = table.select(*Rule.__dataclass_fields__).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of rules has {most} rows at most")
    return tuple(Rule(**r.asDict()) for r in sorted(rows, key=lambda r: r["name"]))


def judge(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text") -> DataFrame:
    """``row`` and all figures, ``base_failed``, ``broken_rules`` (names, joined by ``; ``) and ``kept``."""
    rules = tuple(rules)
    unknown = {x for r in rules for x in (r.figure, r.per)} - {*BASE, *MORE}
    if unknown:
        raise ValueError(f"no such figures: {sorted(unknown)}")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    names = F.concat_ws("; ", *[F.when(broken(r), F.lit(r.name)) for r in rules]) if rules else F.lit("")
    judged = figures(docs, text).select("*", base.alias("base_failed"), names.alias("broken_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


def good_documents(docs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept."""
    return judge(docs, rules).filter("kept").select("row.*")


# ------------------------------------------------------------------------- SQL


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_broken(rule: Rule) -> str:
    bounds = []
    if rule.percent_low is not None:
        bounds.append(f"100 * {rule.figure} < {rule.percent_low} * {rule.per}")
    if rule.percent_high is not None:
        bounds.append(f"100 * {rule.figure} > {rule.percent_high} * {rule.per}")
    return f"{rule.per} > 0 AND n_words >= {rule.from_words} AND ({' OR '.join(bounds) or 'false'})"


def sql(rules: Iterable[Rule] = RULES) -> str:
    """The same figures and verdicts over ``documents``, by exploded windows and lines."""
    white, word = r"'[\x20\x09-\x0D]+'", r"'[^\x20\x09-\x0D]'"
    bare = f"translate(t, {_sql_text(MARKS + LARGE)}, {_sql_text(' ' * len(MARKS) + SMALL)})"
    stops = ", ".join(_sql_text(w) for w in dict.fromkeys(STOP_WORDS))
    names = ", ".join(f"CASE WHEN {_sql_broken(r)} THEN {_sql_text(r.name)} END" for r in rules)
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, list_filter(string_split_regex(t, {white}), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS lines
  FROM texts),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM parts)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT r, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, {white}, '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, {_sql_text(SYMBOLS)}, '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(t) - length(translate(t, {_sql_text(MARKS)}, '')) AS BIGINT) AS n_marks,
         CAST(len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_worded,
         CAST(len(list_filter(string_split_regex({bare}, {white}), lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM parts LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         concat_ws('; ', {names}) AS broken_rules
  FROM counted)
SELECT *, NOT base_failed AND broken_rules = '' AS kept FROM judged"""
