"""Spelling variants: near words of a vocabulary, and the common form each one leads to.

1. *Vocabulary.* Runs of letters of every text, counted by groups that are combined
   before the shuffle; a word that makes a third of all runs is one row a task.
2. *Blocks.* Of two words with one edit between them, the longer of ``m`` code points, ``m // 2``
   code points are alike at the beginning or at the end. Each word is dealt to four
   blocks: by its beginning and its end, for ``m`` its own length and one more. A block of
   more than ``BLOCK_WORDS`` words, or of too long ones, is dealt again by the same rule applied to what is
   left between the parts its words share, until that is one code point, of which there
   are no more than the alphabet has: no block is cut or skipped.
3. *Sorted-list dynamic programming.* A block's words, sorted by the part they need not share,
   are scanned once, against those of full length as queries. Rows of the edit matrix, three
   cells wide around the diagonal, stand on a stack; the next word takes those of the
   prefix it shares with the one before and computes only the rest. The queries are sorted, too:
   those that share what a row has read of them are one range with one row. A range stays
   on the stack while a cell of its row is at most one; where none is left, the scan goes on
   behind all words that share that prefix.
4. *Forms.* The near words of each word are grouped to its number of near words and its form, and
   forms are followed to their roots by doubling: counts grow at least tenfold at each step.

Blocks reach Python sorted by Spark and are read one after another; a task holds one
block. Pairs found in two blocks are made one.

Results for odd input: null, empty and letterless texts have no words; a null ``doc_id``
counts as the empty string before the colon; repeated rows count each; a very long run is one
word; words with the same count are told apart by code points; an empty table gives no
rows; other columns are not read.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text, written

RUN = r"[A-Za-zÀ-ÿ]+"
LARGE, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_LENGTH, LEAST_COUNT = 7, 2

# A word's form is this many times as frequent as the word, or more.
RATIO = 10

# One run in so many loses a code point, chosen by the hash of its document and itself.
THINNED = 31

# Words that are compared in one task at once, and the code points to compare of all of them.
BLOCK_WORDS, BLOCK_CODES = 2_048, 1 << 17


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of the texts, each with the number of its runs."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(whole_text(), F.lit(RUN), F.lit(0))).alias("run"))
    # A word is no longer than its run.
    runs = runs.filter(F.length("run") >= least_length).select("doc_id", F.translate("run", LARGE, SMALL).alias("run"))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = runs.select("run", F.crc32(F.encode(F.concat(number, F.lit(":"), F.col("run")), "UTF-8")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substr("run", place + 2))
    words = hashed.select(F.when(F.col("h") % THINNED == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


# ----------------------------------------------------------------------- blocks

_KEY = ["longer", "head", "tail"]


def _dealt(blocks: DataFrame) -> DataFrame:
    """Rows of ``longer, head, tail, rest`` dealt by the first and the last half of what is left.

    ``rest`` is at most one code point shorter than what the longer words of the block have left.
    """
    left = F.col("longer") - F.length("head") - F.length("tail")
    half = F.floor(left / 2).cast("int")
    size = F.length("rest")
    ways = F.array(
        F.struct(
            F.concat("head", F.substring("rest", F.lit(1), half)).alias("head"), F.col("tail"), F.substr("rest", half + 1).alias("rest")
        ),
        F.struct(
            F.col("head"),
            F.concat(F.substr("rest", size - half + 1), F.col("tail")).alias("tail"),
            F.substring("rest", F.lit(1), size - half).alias("rest"),
        ),
    )
    return blocks.select("longer", F.explode(ways).alias("_way")).select("longer", "_way.*")


def _first_blocks(words: DataFrame) -> DataFrame:
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer")
    return _dealt(words.select(longer, F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("rest")))


def near_pairs(words: DataFrame, block_words: int | None = None) -> DataFrame:
    """``a, b`` with ``a < b``: all pairs of the distinct, not empty words of ``word`` with one edit between them."""
    most = block_words or BLOCK_WORDS
    found = None
    dealt = _first_blocks(words.select("word"))
    while True:
        dealt = written(dealt, "spelling-blocks")
        sizes = dealt.groupBy(*_KEY).agg(F.count("*").alias("_size")).filter("_size > 1")
        sizes = written(sizes, "block-sizes")
        left = F.col("longer") - F.length("head") - F.length("tail")
        # One code point that is left is compared whatever the alphabet's size.
        fits = ((F.col("_size") <= most) & (F.col("_size") * left <= BLOCK_CODES)) | (left <= 1)
        ready = dealt.join(sizes.filter(fits).drop("_size"), _KEY, "left_semi")
        ready = ready.repartition(*_KEY).sortWithinPartitions(*_KEY, "rest")
        pairs = written(ready.mapInArrow(_compared, "a string, b string"), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = sizes.filter(~fits).drop("_size")
        if crowded.isEmpty():
            return found.distinct()
        dealt = _dealt(dealt.join(crowded, _KEY, "left_semi"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of all blocks of a partition, which come one after another."""
    found = []
    for (longer, head, tail), rests in _blocks(batches):
        size = longer - len(head) - len(tail)
        # One word of a pair has the full length; two shorter ones meet in another block.
        full = [r for r in rests if len(r) == size]
        for i, j in scan(full, rests):
            if len(rests[j]) < size or full[i] < rests[j]:
                found.append(tuple(sorted((head + full[i] + tail, head + rests[j] + tail))))
        if len(found) >= 10_000:
            yield _batch(found)
            found = []
    yield _batch(found)


def _batch(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    key, rests = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_KEY, "rest")]
        for *new, rest in zip(*columns):
            if new != key:
                if key:
                    yield key, rests
                key, rests = new, []
            rests.append(rest)
    if key:
        yield key, rests


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        low, n = (middle, n) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def _next_states() -> list[int]:
    """The row after a row, for each three cells (0, 1, or 2 for more) and each three comparisons; -1: all above one."""
    states = []
    for unlike in range(8):
        for row in range(27):
            left, on, right = row % 3, row // 3 % 3, row // 9
            u, v, w = unlike % 2, unlike // 2 % 2, unlike // 4
            left = min(left + u, on + 1, 2)
            on = min(on + v, right + 1, left + 1, 2)
            right = min(right + w, on + 1, 2)
            states.append(-1 if left == on == right == 2 else left + 3 * on + 9 * right)
    return states


_NEXT = _next_states()

# Row 0: no cell before the diagonal, 0 on it, 1 behind it.
_START = 2 + 3 * 0 + 9 * 1


class _Ranges:
    """Sorted queries as ranges that share a prefix, split as the prefix grows."""

    def __init__(self, queries: list[str]):
        # A column before the first code point and two behind the last that equal none.
        self.padded = ["\0" + q + "\0\0" for q in queries]
        self.shared = [0, *map(shared_prefix, queries, queries[1:])]
        self.split: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def of(self, low: int, high: int, n: int) -> list[tuple[int, int]]:
        """The parts of a range whose queries share ``n`` code points, or are shorter and alone."""
        if high - low == 1:
            return [(low, high)]
        found = self.split.get((low, n))
        if found is None:
            cuts = [low, *(k for k in range(low + 1, high) if self.shared[k] < n), high]
            found = self.split[low, n] = list(zip(cuts, cuts[1:]))
        return found


def scan(queries: list[str], words: list[str]) -> list[tuple[int, int]]:
    """All ``i, j`` with exactly one edit between ``queries[i]`` and ``words[j]``, both sorted and distinct.

    ``stack[d]`` belongs to the current word's first ``d`` code points: the ranges of queries
    that are still within one edit of them, and the cells of row ``d`` at columns ``d - 1``,
    ``d`` and ``d + 1``, which depend on no more than the ``d + 1`` code points a range shares.
    """
    if not queries:
        return []
    ranges = _Ranges(queries)
    padded, lengths = ranges.padded, [len(q) for q in queries]
    stack = [[(low, high, _START) for low, high in ranges.of(0, len(queries), 1)]]
    pairs = []
    j, previous = 0, ""
    while j < len(words):
        word = words[j]
        del stack[shared_prefix(previous, word) + 1 :]
        previous = word
        while stack[-1] and len(stack) <= len(word):
            d = len(stack)
            here, row = word[d - 1], []
            for low, high, state in stack[-1]:
                for start, end in ranges.of(low, high, d + 1):
                    q = padded[start]
                    unlike = (q[d - 1 : d] != here) + 2 * (q[d : d + 1] != here) + 4 * (q[d + 1 : d + 2] != here)
                    after = _NEXT[27 * unlike + state]
                    if after >= 0:
                        row.append((start, end, after))
            stack.append(row)
        if not stack[-1]:
            # Whoever shares this prefix is out of reach of all queries.
            prefix = word[: len(stack) - 1]
            j += 1
            while j < len(words) and words[j].startswith(prefix):
                j += 1
            continue
        for low, high, state in stack[-1]:
            cells = (state % 3, state // 3 % 3, state // 9)
            for i in range(low, high):
                column = lengths[i] - len(word) + 1
                if 0 <= column <= 2 and cells[column] == 1:
                    pairs.append((i, j))
        j += 1
    return pairs


# ------------------------------------------------------------------------ forms


def spelling_forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (``word, n``)."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("less"), F.col("b").alias("near")))
    near = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("_best"))
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("_best.near").alias("_near"), (-F.col("_best.less")).alias("_n")
    )
    enough = F.col("_n") >= ratio * F.col("n")
    formed = formed.select(
        "word", "n", "n_near", F.when(enough, F.col("_near")).alias("form"), F.when(enough, F.col("_n")).alias("form_n")
    )
    formed = written(formed, "spelling-forms")
    roots = _roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """The last word that the forms lead to. The way is doubled until nothing moves."""
    roots = forms
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = roots.join(onward, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        )
        moved = written(moved, "spelling-roots")
        roots = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the vocabulary of ``docs``."""
    words = written(vocabulary(docs), "vocabulary")
    return spelling_forms(words, near_pairs(words))
