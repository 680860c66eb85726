"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are its context and
its text alone is trained on. The formatted text of a conversation is stored once, one
row a turn, and an example is a span of it: the first ``target_start`` characters are
the context, the characters up to ``target_end`` the target. Contexts written out one
by one would grow with the square of a conversation's length; ``example_texts`` writes
them out for whoever wants that.

A turn reads ``### role:``, its text, ``</turn>``, each on lines of their own. A run of
three or more ``#`` and the string ``</turn>`` inside a text get one backslash more than
they have in front, which reading takes off again; no other text changes. In a role,
backslashes and line breaks are written ``\\\\`` and ``\\n``.

Results for odd input: a null text or role is empty; rows of equal turn follow by role,
then text; a null turn comes last; null is a conversation of its own; repeated rows
are turns of their own; an empty table gives no rows; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import whole_text
from .ranks import running_totals

# The template.
HEADER, HEADER_END, TURN_END = "### ", ":\n", "\n</turn>\n"
_CONTROL = r"#{3,}|</turn>"

TRAINED_ROLE = "assistant"

# Turns of a conversation whose lengths are added up in one task.
CHUNK_TURNS = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({_CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*(?:{_CONTROL}))", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, start, formatted, target_start, target_end`` for each turn.

    ``start`` is where the turn begins in its conversation. The targets are null
    for turns that are not trained on. A long conversation is added up in chunks.
    """
    role, text = whole_text("role"), escape(whole_text("text"))
    header = F.concat(F.lit(HEADER), _escape_role(role), F.lit(HEADER_END))
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_key"),
        F.concat(header, text, F.lit(TURN_END)).alias("formatted"),
        F.length(header).cast("long").alias("_header"),
        F.length(text).cast("long").alias("_text"),
        (role == TRAINED_ROLE).alias("_trained"),
    )
    # A null turn goes to a chunk after all others.
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit((1 << 62)))
    order = [F.col("turn").asc_nulls_last(), "formatted"]
    placed = running_totals(rows, ["_key"], chunk, order, F.length("formatted"))
    begin = F.col("before") + F.col("_header")
    return placed.select(
        "conv_id",
        "turn",
        F.col("before").alias("start"),
        "formatted",
        F.when(F.col("_trained"), begin).alias("target_start"),
        F.when(F.col("_trained"), begin + F.col("_text")).alias("target_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """``conv_id, start, target_start, target_end``: one example for each turn that is trained on.

    Its context is the conversation's first ``target_start`` characters, its target goes on to
    ``target_end``, in the turn that begins at ``start``.
    """
    return formatted.filter("target_start is not null").select("conv_id", "start", "target_start", "target_end")


def example_targets(formatted: DataFrame, expanded: DataFrame) -> DataFrame:
    """``conv_id, start, target``: of each example the unescaped text under its loss mask, read from the formatted text."""
    example = expanded.select(
        F.col("conv_id").alias("_conv_id"), F.col("start").alias("_start"), F.col("target_start").alias("_from"), F.col("target_end").alias("_to")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("start") == F.col("_start"))
    target = F.substr("formatted", (F.col("_from") - F.col("start") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int"))
    return formatted.select("conv_id", "start", "formatted").join(example, same).select("conv_id", "start", unescape(target).alias("target"))


def example_texts(formatted: DataFrame) -> DataFrame:
    """``conv_id, target_start, target_end, text``: every example written out.

    ``text`` is the context and the target. The size grows with the square of a
    conversation's length, and a conversation must fit in a task.
    """
    so_far = Window.partitionBy("conv_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    text = F.array_join(F.collect_list("formatted").over(so_far), "")
    return (
        formatted.select("conv_id", "target_start", "target_end", text.alias("text"))
        .filter("target_start is not null")
        .withColumn("text", F.substr("text", F.lit(1), F.col("target_end").cast("int")))
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """``conv_id, start, role, text, n_chars`` parsed from the formatted text."""
    header = F.regexp_extract("formatted", r"\A### ([^\n]*):\n", 1)
    body_start = F.length(header) + len(HEADER) + len(HEADER_END)
    body = F.substr("formatted", body_start + 1, F.length("formatted") - body_start - len(TURN_END))
    return formatted.select(
        "conv_id",
        "start",
        _unescape_role(header).alias("role"),
        unescape(body).alias("text"),
        F.length("formatted").alias("n_chars"),
    )


_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def conversation_digests(formatted: DataFrame, expanded: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back.

    The turns are those of the formatted text, the loss that of the examples in ``expanded``. A digest takes its turns one after another, so those of a conversation pass
    through one task; it holds the state of one digest and a batch of turns.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
            + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )
        current, state, done = None, None, []

        def finish():
            done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv_id, _, example, role, text, n_chars in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv_id != current:
                    if state is not None:
                        finish()
                    current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if example:
                    state[2] += len(text)
                    state[3].update(text.encode())
                else:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[4] += n_chars
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=schema)
            done.clear()
        if state is not None:
            finish()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=schema)

    turns = read_turns(formatted).select("conv_id", "start", F.lit(False).alias("example"), "role", "text", "n_chars")
    targets = example_targets(formatted, expanded).select(
        "conv_id", "start", F.lit(True), F.lit(""), "target", F.lit(0)
    )
    rows = turns.union(targets).repartition("conv_id").sortWithinPartitions("conv_id", "start", "example")
    return rows.mapInArrow(digest, _DIGESTS)
