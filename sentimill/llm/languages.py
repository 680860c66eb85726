"""Language identification by Bayesian fusion of evidence.

For each row, the probability of a language is the product of

- *text*: the likelihood of its letter trigrams, learnt from labelled documents; a row that
  is learnt from is taken out of its language's counts before it is weighed. Trigrams
  overlap, so the logarithm counts with a weight below one;
- *declared language*: how much more often rows of a language declare this value than
  others do, so a value that is declared whatever the text says counts for nothing;
- *address*: a prior of the row's host, smoothed towards that of its domain, this
  towards its address suffix, this towards all rows.

The counts behind the last two are sums of what the text alone says, by grouped
aggregation over all rows, and a row's own part is taken out of the counts that it
meets. Besides the languages there is ``und``, text of none of them, in which
every trigram is equally likely. A row is rejected if that is the best answer, or
if no language reaches the lowest probability.

Results for odd input: a null or empty text, or one without letters, has no text
evidence, and address and declaration decide; a null address or declaration is no
evidence; repeated rows count once each; an empty table gives no rows. The languages are those of the labels: two or three letters,
up to the first other character, in any case; rows with another label or none are not learnt
from, and if nothing is labelled, the text says nothing. Of a language's only row nothing
is left to learn from, so its text is evidence for no language. Columns of any name pass
through in ``row``. A long text is read in blocks.
"""

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text, written

UNKNOWN = "und"

# Trigrams are told apart by this many bits of their hash.
BITS = 16

# Added to the count of each trigram.
SMOOTHING = 0.1

# What one of the overlapping trigrams counts as evidence.
TEXT_WEIGHT = 0.5

# Prior of text in none of the languages.
UNKNOWN_PRIOR = 1e-3

# Rows that the upper level counts as: a host with as many rows weighs as much as its domain.
LEVEL_WEIGHT = 20.0

# A row that declares another language than it is written in, at least.
WRONG_DECLARATION = 0.02

LEAST_PROBABILITY = 0.5

# Rejected rows up to this size are broadcast.
BROADCAST_BYTES = 64 << 20

# Code points read at once.
BLOCK = 1 << 20

# Languages whose counts a task holds before it passes them on.
HELD = 64


# ------------------------------------------------------------------------ text


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all trigrams with two or more letters, block by block; other characters are spaces."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    for start in range(0, len(codes) - 2, BLOCK):
        part = codes[start : start + BLOCK + 2]
        letter = _letters()[part]
        part = np.where(letter, part, 32).astype(np.uint64)
        mixed = part[:-2] * np.uint64(0x9E3779B97F4A7C15) + part[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed + part[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        several = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2
        yield ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - BITS))[several].astype(np.int64)


_UNSEEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def visible_text(markup: str) -> str:
    """What a page shows: no scripts, styles, comments or tags, entities resolved."""
    return _html.unescape(_UNSEEN.sub(" ", markup))


def histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text and how often they occur."""
    whole = None
    for found in trigrams(text):
        if whole is None and len(text) < BLOCK:
            return np.unique(found, return_counts=True)
        whole = np.zeros(1 << BITS, np.int64) if whole is None else whole
        whole += np.bincount(found, minlength=1 << BITS)
    whole = np.zeros(0, np.int64) if whole is None else whole
    seen = np.flatnonzero(whole)
    return seen, whole[seen]


class TrigramCounts(NamedTuple):
    """How often each trigram occurs in each language: a row of ``counts`` for each of ``languages``."""

    languages: tuple[str, ...]
    counts: np.ndarray


def language_of(label: Column) -> Column:
    """The language that a label names, in lower case; null if it names none."""
    found = F.lower(F.regexp_extract(F.trim(label), r"\A([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when((found != "") & (found != UNKNOWN), found)


def trigram_counts(labelled: DataFrame) -> TrigramCounts:
    """Counts over all texts (``text, lang``) of each language that a label names.

    The driver gets ``2 ** BITS`` rows a language at most.
    """

    def rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], names=["lang", "trigram", "n"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held and len(held) >= HELD:
                    yield from rows(held)
                    held = {}
                counts = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                seen, n = histogram(text.as_py())
                counts[seen] += n
        yield from rows(held)

    texts = labelled.select(language_of(F.col("lang")).alias("lang"), whole_text().alias("text")).filter("lang is not null")
    counted = texts.mapInArrow(count, "lang string, trigram long, n long")
    table = counted.groupBy("lang", "trigram").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(table["lang"].to_pylist())))
    counts = np.zeros((len(languages), 1 << BITS), np.int64)
    place = {lang: i for i, lang in enumerate(languages)}
    row = np.array([place[x] for x in table["lang"].to_pylist()], np.int64)
    counts[row, table["trigram"].to_numpy()] = table["n"].to_numpy()
    return TrigramCounts(languages, counts)


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log probability of each trigram in each language, and last in none: evenly spread."""
    smoothed = counts + SMOOTHING
    known = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
    return np.vstack([known, np.full(1 << BITS, -BITS * np.log(2))]).T.astype(np.float32)


# --------------------------------------------------------------------- address


def host(url: Column) -> Column:
    """The host of an address, lower case, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"(?i)\A\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@\s]*@)?([^/?#:@\s]+)", 1))
    return F.when(found != "", found)


def declared_in_markup(markup: Column) -> Column:
    """The primary language of the ``lang`` attribute of the ``html`` tag; null if there is none."""
    found = F.lower(F.regexp_extract(markup, r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,8})", 1))
    return F.when(found != "", found)


def _levels(host: Column) -> dict[str, Column]:
    """Suffix, domain and host of a host name; a name without dots is all three."""
    return {
        "suffix": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "host": host,
    }


# ---------------------------------------------------------------------- fusion


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _text_evidence(rows: DataFrame, learnt: TrigramCounts, is_markup: bool) -> DataFrame:
    """``row, host, declared, n_trigrams, evidence``: weighted log likelihoods of the text.

    A row with a ``_label`` is part of the counts of that language, and is taken out of them.
    """
    place = {lang: i for i, lang in enumerate(learnt.languages)}
    shared = rows.sparkSession.sparkContext.broadcast((log_likelihoods(learnt.counts), learnt.counts, learnt.counts.sum(axis=1)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, totals = shared.value
        for batch in batches:
            sizes, sums = [], []
            for text, label in zip(batch.column("_text"), batch.column("_label").to_pylist()):
                seen, often = histogram(visible_text(text.as_py()) if is_markup else text.as_py())
                n = int(often.sum())
                sum_ = often.astype(np.float64) @ table[seen]
                if (own := place.get(label)) is not None:
                    others = np.log(counts[own, seen] - often + SMOOTHING) - np.log(totals[own] - n + SMOOTHING * (1 << BITS))
                    sum_[own] = often @ others
                sizes.append(n)
                sums.append(TEXT_WEIGHT * sum_)
            kept = batch.drop_columns(["_text", "_label"])
            evidence = pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sizes, pa.int64()), evidence], names=[*kept.schema.names, "n_trigrams", "evidence"]
            )

    kept = rows.drop("_text", "_label").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_trigrams long, evidence array<double>"
    return rows.mapInArrow(weigh, schema)


def _even_prior(width: int) -> np.ndarray:
    """All languages alike, and none of them rarely."""
    return np.array([(1 - UNKNOWN_PRIOR) / max(width - 1, 1)] * (width - 1) + [UNKNOWN_PRIOR])


def _vector_sum(width: int) -> Column:
    return F.array(*[F.sum(F.col("said")[i]) for i in range(width)])


def identify(
    rows: DataFrame,
    learnt: TrigramCounts,
    text: str | None = "text",
    markup: str | None = None,
    host_name: Column | None = None,
    declared: Column | None = None,
    carry: list[str] | None = None,
    label: Column | None = None,
) -> DataFrame:
    """``row, language, probability, text_language, n_trigrams, rejected`` for each of ``rows``.

    The text is in column ``text``, or shown by the page in column ``markup``. ``row`` is
    the row as it came, or its columns ``carry``; these travel with the row. ``label`` is what
    the rows themselves have been learnt as, if they have been.
    """
    names = [*learnt.languages, UNKNOWN]
    width = len(names)
    nothing = F.lit(None).cast("string")
    declaration = F.lower(F.regexp_extract(F.trim(declared), r"\A[A-Za-z]+", 0)) if declared is not None else nothing
    prepared = rows.select(
        F.struct(*(carry or ["*"])).alias("row"),
        (host_name if host_name is not None else nothing).alias("host"),
        F.when(declaration != "", declaration).alias("declared"),
        whole_text(markup or text).alias("_text"),
        (language_of(label) if label is not None else nothing).alias("_label"),
    )
    weighed = _text_evidence(prepared, learnt, markup is not None)
    # What the text alone says, ``und`` being rare; a row without letters says nothing.
    prior = np.log(_even_prior(width))
    alone = F.transform(F.arrays_zip("evidence", F.lit(prior.tolist()).alias("prior")), lambda x: x["evidence"] + x["prior"])
    largest = F.array_max("_alone")
    raised = F.transform("_alone", lambda x: F.exp(x - largest))
    total = F.aggregate("_raised", F.lit(0.0), lambda a, b: a + b)
    said = F.when(F.col("n_trigrams") > 0, F.transform("_raised", lambda x: x / total))
    silent = F.lit([0.0] * width)
    weighed = (
        weighed.withColumn("_alone", alone)
        .withColumn("_raised", raised)
        .withColumn("said", F.coalesce(said, silent))
        .drop("_alone", "_raised")
    )
    weighed = written(weighed, "text-evidence")

    levels = _levels(F.col("host"))
    overall = weighed.agg(_vector_sum(width).alias("said")).first()["said"]
    overall = [x or 0.0 for x in overall]
    by_host = weighed.filter("host is not null").groupBy("host").agg(_vector_sum(width).alias("said"))
    by_host = written(by_host.select("host", levels["domain"].alias("domain"), levels["suffix"].alias("suffix"), "said"), "hosts")
    by_domain = by_host.groupBy("domain").agg(_vector_sum(width).alias("said_domain"))
    by_suffix = by_host.groupBy("suffix").agg(_vector_sum(width).alias("said_suffix"))
    addresses = (
        by_host.withColumnRenamed("said", "said_host")
        .join(by_domain, "domain")
        .join(by_suffix, "suffix")
        .select("host", "said_host", "said_domain", "said_suffix")
    )
    by_declared = weighed.filter("declared is not null").groupBy("declared").agg(_vector_sum(width).alias("said_declared"))
    joined = weighed.join(addresses, "host", "left").join(by_declared, "declared", "left")
    all_declared = by_declared.agg(*[F.sum(F.col("said_declared")[i]) for i in range(width)]).first()
    all_declared = [x or 0.0 for x in all_declared]

    given = ["evidence", "said", "said_host", "said_domain", "said_suffix", "said_declared", "declared"]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = {c: _matrix(batch.column(c), width) for c in given[:-1]}
            own = values["said"]
            fused = values["evidence"] + np.log(_address_prior(values, np.array(overall), own))
            declared_as = batch.column("declared").to_pylist()
            matches = np.array([[d == name for name in names] for d in declared_as], bool).reshape(n, width)
            fused += np.log(_declaration(values["said_declared"], np.array(all_declared), own, matches))
            posterior = _softmax(fused) if n else fused
            best, text_best = posterior.argmax(axis=1), values["evidence"].argmax(axis=1)
            probability = posterior[np.arange(n), best]
            quiet = np.array(batch.column("n_trigrams").to_pylist(), np.int64) == 0
            rejected = (best == width - 1) | (probability < LEAST_PROBABILITY)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([names[i] for i in best], pa.string()),
                    pa.array(probability, pa.float64()),
                    pa.array([None if q else names[i] for i, q in zip(text_best, quiet)], pa.string()),
                    batch.column("n_trigrams"),
                    batch.column("declared"),
                    batch.column("host"),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["row", "language", "probability", "text_language", "n_trigrams", "declared", "host", "rejected"],
            )

    row_type = joined.schema["row"].dataType.simpleString()
    return joined.select("row", "n_trigrams", "host", *given).mapInArrow(
        fuse,
        f"row {row_type}, language string, probability double, text_language string, n_trigrams long, "
        "declared string, host string, rejected boolean",
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; zeros where it is null."""
    return np.array([x if x is not None else [0.0] * width for x in column.to_pylist()], float).reshape(len(column), width)


def _address_prior(values: dict[str, np.ndarray], overall: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Counts of a level plus ``LEVEL_WEIGHT`` rows of the level above, without the row itself."""
    width = len(overall)
    prior = np.broadcast_to(_even_prior(width), own.shape)
    for level in (np.broadcast_to(overall, own.shape), values["said_suffix"], values["said_domain"], values["said_host"]):
        # A row without an address meets zeros, which leave the level above as it is.
        counted = np.maximum(level - own, 0.0)
        prior = (counted + LEVEL_WEIGHT * prior) / (counted.sum(axis=1, keepdims=True) + LEVEL_WEIGHT)
    return prior


def _declaration(counted: np.ndarray, total: np.ndarray, own: np.ndarray, matches: np.ndarray) -> np.ndarray:
    """How likely rows of each language are to declare this value, against all rows.

    A value of few rows is believed to say what it names, mostly.
    """
    width = len(total)
    counted = np.maximum(counted - own, 0.0)
    named = matches.any(axis=1, keepdims=True)
    believed = np.where(named, np.where(matches, 1 - WRONG_DECLARATION, WRONG_DECLARATION / max(width - 1, 1)), 1 / width)
    share = (counted + LEVEL_WEIGHT * believed) / (counted.sum(axis=1, keepdims=True) + LEVEL_WEIGHT)
    usual = (total + LEVEL_WEIGHT / width) / (total.sum() + LEVEL_WEIGHT)
    ratio = np.maximum(share, WRONG_DECLARATION / width) / usual
    # No declaration, no evidence; nor is one against text of no language.
    ratio = np.where(counted.any(axis=1, keepdims=True) | named, ratio, 1.0)
    ratio[:, -1] = np.maximum(ratio[:, -1], ratio[:, :-1].min(axis=1)) if ratio[:, :-1].size else ratio[:, -1]
    return ratio


# ------------------------------------------------------------------- documents


def identify_documents(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Languages of ``docs`` (``text, lang, source``): ``lang`` is declared, ``source`` the host.

    The labels are at the same time what the trigrams are learnt from, each row from the others.
    """
    declared = F.col("lang")
    return identify(docs, trigram_counts(docs), host_name=F.col("source"), declared=declared, carry=carry, label=declared)


def identify_pages(pages: DataFrame, learnt: TrigramCounts, carry: list[str] | None = None) -> DataFrame:
    """Languages of ``pages`` (``url, html``), with trigrams learnt elsewhere."""
    return identify(
        pages, learnt, markup="html", host_name=host(F.col("url")), declared=declared_in_markup(F.col("html")), carry=carry
    )


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns that are not rejected.

    Decisions are made on narrow rows. The rejected ones are sent to all tasks if they
    are few, by their size; else both sides are shuffled.
    """
    keyed = docs.withColumn("_text_hash", F.xxhash64(whole_text()))
    key = ["doc_id", "source", "lang", "_text_hash"]
    rejected = identify_documents(keyed, carry=key).filter("rejected").select("row.*").distinct()
    rejected = written(rejected.toDF("_1", "_2", "_3", "_4"), "rejected")
    size = rejected.agg(F.sum(F.lit(64) + F.octet_length("_2") + F.octet_length("_3"))).first()[0] or 0
    same = F.lit(True)
    for ours, theirs in zip(key, rejected.columns):
        same = same & keyed[ours].eqNullSafe(rejected[theirs])
    left = keyed.join(F.broadcast(rejected) if size <= BROADCAST_BYTES else rejected, same, "left_anti")
    return left.drop("_text_hash")
