"""Document fingerprints from closed syncmers.

Of all runs of ``K`` code points, those are chosen whose smallest inner run of ``S``
code points (by hash) stands at the run's start or end. Whether a run is chosen depends
on the run alone, so a passage chooses the same anchors in every text, at positions
that differ by the same distance. One run in about (K - S + 1) / 2 is chosen.

A fingerprint is the 32-bit hashes of the anchors in the order of their positions, as
base64. A text that chooses no run, as all of fewer than ``K`` code points, has one
anchor, itself. Likeness is twice the anchors in common over the anchors of both, repeats
counted: 1 for equal texts, and the overlap of two texts in general.

Results for odd input: a null text is empty; an empty table gives no rows; a single
document is its own next; rows of equal ``doc_id`` follow by text, a null ``doc_id`` comes
last, repeated rows stand side by side; other columns are ignored. A long text is
hashed in blocks.
"""

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from .common import whole_text, written

K, S = 16, 4

# Ranges of documents for each shuffle partition.
RANGES = 4

# Code points hashed at once.
BLOCK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(32))) * _MIX


def _run_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` (a power of two) codes, from those of its halves."""
    h, n = _mixed(codes + np.uint64(1)), 1
    while n < length:
        h = _mixed(h[:-n] * _BASE + h[n:])
        n *= 2
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def _anchors(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    inner = _run_hashes(codes, s)
    width = k - s + 1
    smallest = _sliding_min(inner, width)
    chosen = (inner[: len(smallest)] == smallest) | (inner[width - 1 :] == smallest)
    at = np.flatnonzero(chosen)
    return at, (_run_hashes(codes, k)[at] >> np.uint64(32)).astype("<u4")


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from 0) and hashes of the anchors of ``text``; ``k`` and ``s`` are powers of two."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    found = [
        (at + start, hashes)
        for start in range(0, len(codes) - k + 1, BLOCK)
        for at, hashes in [_anchors(codes[start : start + BLOCK + k - 1], k, s)]
    ]
    if not any(len(at) for at, _ in found):
        own = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little")
        return np.zeros(1, np.int64), np.array([own], "<u4")
    return tuple(np.concatenate(parts) for parts in zip(*found))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the common hashes over all hashes, repeats counted."""
    if len(a) + len(b) == 0:
        return 1.0
    values_a, counts_a = np.unique(a, return_counts=True)
    values_b, counts_b = np.unique(b, return_counts=True)
    _, in_a, in_b = np.intersect1d(values_a, values_b, assume_unique=True, return_indices=True)
    return float(2 * np.minimum(counts_a[in_a], counts_b[in_b]).sum() / (len(a) + len(b)))


def shared_anchors(a: str, b: str) -> list[tuple[int, int]]:
    """Distances (position in ``b`` minus in ``a``) of anchors that both have once, with their number.

    A passage of both shows as many anchors of one distance.
    """
    (at_a, hash_a), (at_b, hash_b) = anchors(a), anchors(b)
    once_a, first_a, n_a = np.unique(hash_a, return_index=True, return_counts=True)
    once_b, first_b, n_b = np.unique(hash_b, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(once_a, once_b, assume_unique=True, return_indices=True)
    single = (n_a[i] == 1) & (n_b[j] == 1)
    return Counter((at_b[first_b[j[single]]] - at_a[first_a[i[single]]]).tolist()).most_common()


def _spelled(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def edited_text(text: str, following: str) -> str:
    """``text`` with its second half replaced by as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

def _compared(doc_id, text: str, own: np.ndarray, following: str, following_own: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    edited_own = anchors(edited)[1]
    digest = hashlib.sha256(edited.encode()).hexdigest()
    near = likeness(own, edited_own), likeness(own, following_own)
    return (doc_id, len(text), digest, _spelled(own), _spelled(edited_own), *near)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def _ranges(docs: DataFrame) -> DataFrame:
    """``range, low, high`` of ranges of ``doc_id``, the highest first: Spark's own sort ranges.

    ``RANGES`` for each shuffle partition. Equal ids are in one range, nulls in the last.
    """
    ids = docs.select(F.col("doc_id").cast("long"))
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(n, F.col("doc_id").desc_nulls_last())
    ranged = written(ranged.select("doc_id", F.spark_partition_id().alias("range")), "ranges")
    return ranged.groupBy("range").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("range")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all ``docs`` (``doc_id, text``), and of their texts edited with the next one's.

    The next document is that of the next smaller ``doc_id``; after the last comes the
    first. Texts are shuffled once, by ranges of ids whose limits an earlier pass over
    the ids alone has found, and each task walks along its ranges with two documents
    in memory. The first document of each range goes to the range before as well,
    to be the next of its last.
    """
    ranges = _ranges(docs).collect()  # a few rows for each shuffle partition
    n = max(1, len(ranges))
    lows = np.array([r["low"] for r in reversed(ranges) if r["low"] is not None], np.int64)
    highs = np.array([r["high"] for r in ranges if r["high"] is not None], np.int64)
    unnumbered = n - len(lows)  # 1 if a range has nulls only

    @F.pandas_udf(LongType())
    def place_of(doc_id: pd.Series) -> pd.Series:
        """Twice the range, and one more for the first id of a range."""
        ids, null = doc_id.fillna(0).to_numpy(np.int64), doc_id.isna().to_numpy()
        at = np.where(null, n - 1, n - unnumbered - np.searchsorted(lows, ids, side="right"))
        first = np.where(null, unnumbered == 1, np.isin(ids, highs))
        return pd.Series(2 * at + first)

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    placed = texts.withColumn("_place", place_of("doc_id"))
    range_ = F.floor(F.col("_place") / 2)
    here = F.struct(range_.alias("range"), F.lit(False).alias("ends"))
    before = F.struct(F.pmod(range_ - 1, F.lit(n)).alias("range"), F.lit(True).alias("ends"))
    places = F.explode(F.when(F.col("_place") % 2 == 1, F.array(here, before)).otherwise(F.array(here))).alias("at")
    order = ["range", "ends", F.col("doc_id").desc_nulls_last(), F.desc("text")]
    placed = (
        placed.select("doc_id", "text", places)
        .select("at.range", "at.ends", "doc_id", "text")
        .repartition("range")
        .sortWithinPartitions(*order)
    )
    return placed.mapInArrow(_walk, _RESULT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of a range with the one after it."""
    current, before, rows = None, None, []
    for batch in batches:
        for at, ends, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != current:
                current, before = at, None
            # Of several rows that share the id after a range, the first ends it.
            if ends and before is None:
                continue
            own = anchors(text)[1]
            if before is not None:
                rows.append(_compared(*before, text, own))
            before = None if ends else (doc_id, text, own)
            if len(rows) >= 256:
                yield _batch(rows, _FIELDS)
                rows = []
    yield _batch(rows, _FIELDS)
