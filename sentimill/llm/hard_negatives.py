"""Hard negatives: for each positive of an anchor, the best rows of other labels in a score window.

1. *Blocks.* All rows and all anchors are dealt to blocks by a hash; each block of rows meets
   each block of anchors in a task of its own, where the whole numbers' inner products are one
   matrix product. Scores never leave a task as such.
2. *Positives.* Of a block's scores, an anchor's first rows of its own label leave the task; a
   window over each anchor, limited before its shuffle too, ranks those of all blocks.
3. *Pairs.* The blocks meet again, each anchor with its positives. What leaves the task is packed
   into keys (anchor, descending score, id): the positives themselves, and of the rows of other labels
   the first few in each positive's window, since no block can give more. So what is shuffled
   grows with anchors times blocks, not with anchors times rows.
4. *Secondary sort.* The keys are dealt by anchor and sorted within the partitions by Spark (the
   DataFrame form of repartitionAndSortWithinPartitions, which spills). A streaming iterator
   reads them: a positive opens its window, a negative below it is emitted for every open window that
   it fits, a full or passed window is closed. It holds one anchor's open windows and no more.

Results for odd input: a row with a null label, a null vector, or a component that is null, NaN or
infinite takes no part; vectors of different lengths count as filled up with zeros, an empty one
has the score 0 with all. Rows without ``vec_id`` are no anchors and come after all others among equal
scores. Rows that repeat are rows of their own: each is an anchor, and the others are its
positives; which of two rows with one ``vec_id`` and score comes first changes nothing in the result. Whole
numbers are exact; a component or a score outside the range of a double or a long becomes the nearest one. An anchor without positives, or a positive
without negatives, gives no rows, and neither does an empty table. Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3

# A negative's score in percent of the positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95

# Rows of a block, on average.
BLOCK_ROWS = 4_096

_MOST, _LARGEST = (1 << 63) - 1, np.finfo(np.float64).max

# Sums of products stay exact in doubles below this.
_EXACT = 1 << 53


def usable_rows(rows: DataFrame) -> DataFrame:
    """``vec_id, label, embedding``, with a number of its own for each row that takes part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vector = F.col("embedding")
    if dict(rows.dtypes)["embedding"] != "array<float>":
        vector = vector.cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vector.alias("embedding")).filter(
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    )
    return written(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _block(n_blocks: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n_blocks)).cast("int")


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """All rows and all anchors, each block of the ones with each block of the others.

    ``anchors`` has ``wanted``, the scores of the positives, too.
    """
    row_blocks, anchor_blocks = -(-n_rows // BLOCK_ROWS), -(-n_anchors // BLOCK_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("a", every(anchor_blocks)).select(
        _block(row_blocks, 0).alias("r"), "a", F.lit(False).alias("anchor"), *rows.columns, F.array().cast("array<long>").alias("wanted")
    )
    dealt = anchors.withColumn("r", every(row_blocks)).select(
        "r", _block(anchor_blocks, 1).alias("a"), F.lit(True).alias("anchor"), *rows.columns, "wanted"
    )
    return candidates.unionByName(dealt).groupBy("r", "a")


# ------------------------------------------------------------------ within tasks


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The whole-number vectors as rows of doubles, filled up with zeros."""
    vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    with np.errstate(over="ignore"):
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    flat = np.clip(flat, -_LARGEST, _LARGEST)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, held in the range of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -_MOST, _MOST).astype(np.int64)


class _Group:
    """A block of rows and a block of anchors, with all scores between them."""

    def __init__(self, table: pa.Table):
        anchor = table.column("anchor").to_numpy()
        split = lambda mask: table.filter(pa.array(mask))
        self.anchors, self.rows = split(anchor), split(~anchor)
        # Stable sorting by score keeps this order among equal scores; nulls are last.
        self.rows = self.rows.take(pa.compute.sort_indices(self.rows, [("vec_id", "ascending")]))
        self.labels = self.rows.column("label").to_numpy()
        self.of = self.rows.column("row").to_numpy()
        self.scores = inner_products(_matrix(self.anchors.column("embedding")), _matrix(self.rows.column("embedding")))

    def __iter__(self):
        """Each anchor's number, label, wanted scores and all scores."""
        columns = [self.anchors.column(c).to_pylist() for c in ("row", "label", "wanted")]
        return zip(*columns, self.scores)

    def found(self, anchors: list[int], picked: list[np.ndarray], scores: list[np.ndarray]) -> pa.Table:
        at = np.concatenate([np.zeros(0, np.int64), *picked]).astype(np.int64)
        rows = self.rows.take(pa.array(at))
        of = np.repeat(np.array(anchors, np.int64), [len(p) for p in picked])
        score = np.concatenate([np.zeros(0, np.int64), *scores]).astype(np.int64)
        return pa.table({"anchor": of, "score": score, "row": rows.column("row"), "vec_id": rows.column("vec_id")})


_FOUND = "anchor long, score long, row long, vec_id long"


def _first(scores: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """The places of the highest scores, the earliest first among equal ones."""
    if len(among) > 4 * most:
        least = np.partition(scores[among], len(among) - most)[len(among) - most]
        among = among[scores[among] >= least]
    return among[np.argsort(-scores[among], kind="stable")][:most]


def _own_label(table: pa.Table) -> pa.Table:
    """Of each anchor its first rows of the same label, itself left out."""
    group = _Group(table)
    anchors, picked, scores = [], [], []
    for number, label, _, line in group:
        among = np.flatnonzero((group.labels == label) & (group.of != number))
        best = _first(line, among, POSITIVES)
        anchors.append(number)
        picked.append(best)
        scores.append(line[best])
    return group.found(anchors, picked, scores)


def window(positive: int) -> tuple[int, int]:
    """The lowest and the highest score of a negative of this positive; nothing is between them for one below zero."""
    return -(-LEAST_PERCENT * positive // 100), MOST_PERCENT * positive // 100


def _other_labels(table: pa.Table) -> pa.Table:
    """Of each anchor the first rows of other labels in each of its windows."""
    group = _Group(table)
    anchors, picked, scores = [], [], []
    for number, label, wanted, line in group:
        other = group.labels != label
        best = [np.zeros(0, np.int64)]
        for positive in set(wanted):
            low, high = window(positive)
            if low <= high:
                best.append(_first(line, np.flatnonzero(other & (line >= low) & (line <= high)), NEGATIVES))
        chosen = np.unique(np.concatenate(best))
        anchors.append(number)
        picked.append(chosen)
        scores.append(line[chosen])
    return group.found(anchors, picked, scores)


def emitted(keys: Iterator[tuple]) -> Iterator[tuple]:
    """``anchor, row of the positive, rank, vec_id of the negative, its score``, streamed from sorted keys.

    Keys are ``anchor, positive, row, vec_id, score`` by anchor, descending score, positives before
    negatives, then by id.
    """
    current, opened = None, []
    for anchor, positive, row, vec_id, score in keys:
        if anchor != current:
            current, opened = anchor, []
        if positive:
            low, high = window(score)
            if low <= high:
                opened.append([row, low, high, 0])
            continue
        for open_window in opened:
            own, low, high, n = open_window
            if low <= score <= high:
                open_window[3] = n + 1
                yield anchor, own, n + 1, vec_id, score
        # Scores only fall: full windows and those that lie above are done.
        opened = [w for w in opened if w[3] < NEGATIVES and score >= w[1]]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "positive", "row", "vec_id", "score"]
    keys = (key for batch in batches for key in zip(*[batch.column(n).to_pylist() for n in names]))
    out = []
    for row in emitted(keys):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


_EMITTED = ["anchor", "positive_row", "rank", "negative_id", "negative_score"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _EMITTED)


# --------------------------------------------------------------------- operator


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, embedding``; ``is_anchor`` is a condition on these, after unusable
    rows are left out.
    """
    rows = usable_rows(rows)
    anchors = rows.filter(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    unknown = anchors.withColumn("wanted", F.array().cast("array<long>"))
    near = _met(rows, unknown, max(1, n_rows), max(1, n_anchors)).applyInArrow(_own_label, _FOUND)

    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    positives = written(near.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= POSITIVES), "positives")

    scores = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("wanted"))
    known = anchors.join(scores, "row")
    others = _met(rows, known, max(1, n_rows), max(1, n_anchors)).applyInArrow(_other_labels, _FOUND)

    keys = positives.select("anchor", F.lit(True).alias("positive"), "row", "vec_id", "score").unionByName(
        others.select("anchor", F.lit(False).alias("positive"), "row", "vec_id", "score")
    )
    packed = [F.col("anchor"), F.desc("score"), F.desc("positive"), F.asc_nulls_last("vec_id"), F.col("row")]
    mined = keys.repartition("anchor").sortWithinPartitions(*packed).mapInArrow(
        _emit, "anchor long, positive_row long, rank int, negative_id long, negative_score long"
    )
    named = positives.select("anchor", F.col("row").alias("positive_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return mined.join(named, ["anchor", "positive_row"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
