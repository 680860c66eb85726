"""Edit-aware token counts: a segment tree of each document's pre-tokens.

A document is cut before every sure boundary (``bpe``), so the tokens of the text are
those of its pieces. The tree's leaves are runs of about ``LEAF`` pieces with the number
of their characters and tokens; an inner node has the sums of its two children. An
edit finds the leaves that it touches from the sums, cuts and counts the text
again between the nearest sure boundaries outside the edit, keeps every other piece, and
corrects the sums on the way to the root. A leaf that grows too large splits, and the
inner nodes are summed again; no text is encoded for that.

A sure boundary depends on the characters beside it alone, so pieces that end a character
or more before an edit, and those that begin two or more after it, stay as they are.

Edits are replacements of ``length`` characters from ``start`` on, one after another in the
order of ``seq``, each counted in the text that the earlier ones left. Positions count
code points.

Results for odd input: a null text is empty; positions outside the text are moved to its
nearest end, null ones are 0, a null replacement is empty; edits of equal ``seq`` follow by
their other columns, a null ``seq`` first; edits of documents that do not exist are
ignored, and one edit list serves all rows of a repeated ``doc_id``; documents without
edits are only counted; an empty table gives no rows; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import VOCABULARY, Encoder, encoder, pieces
from .common import whole_text

# Pieces in a new leaf, and in one that splits.
LEAF, SPLIT = 32, 128


class TokenTree:
    """The pieces of one text, in leaves under a complete binary tree of sums."""

    def __init__(self, leaves: list[list[str]], tokens: list[list[int]], bpe: Encoder):
        self._bpe = bpe
        self._leaves, self._tokens = leaves, tokens
        self.counted = 0  # characters encoded by edits
        self._sum_up()

    @classmethod
    def of(cls, text: str, bpe: Encoder) -> "TokenTree":
        parts = pieces(text)
        return cls.from_pieces(parts, bpe.counts(parts), bpe)

    @classmethod
    def from_pieces(cls, parts: list[str], tokens: list[int], bpe: Encoder) -> "TokenTree":
        starts = range(0, max(1, len(parts)), LEAF)
        return cls([parts[i : i + LEAF] for i in starts], [tokens[i : i + LEAF] for i in starts], bpe)

    @classmethod
    def stored(cls, text: str, lengths: bytes, tokens: bytes, bpe: Encoder) -> "TokenTree":
        """The tree that ``token_trees`` has written; nothing is encoded."""
        ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        return cls.from_pieces(parts, np.frombuffer(tokens, "<u4").tolist(), bpe)

    def _sum_up(self) -> None:
        self._width = 1 << max(0, (len(self._leaves) - 1).bit_length())
        self._chars = [0] * (2 * self._width)
        self._sums = [0] * (2 * self._width)
        for i, (leaf, tokens) in enumerate(zip(self._leaves, self._tokens), self._width):
            self._chars[i], self._sums[i] = sum(map(len, leaf)), sum(tokens)
        for i in range(self._width - 1, 0, -1):
            self._chars[i] = self._chars[2 * i] + self._chars[2 * i + 1]
            self._sums[i] = self._sums[2 * i] + self._sums[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self._chars[1]

    @property
    def n_tokens(self) -> int:
        return self._sums[1]

    def text(self) -> str:
        return "".join(part for leaf in self._leaves for part in leaf)

    def node_sums(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of all nodes; node 1 is the root, 2i and 2i+1 the children of i."""
        return self._chars, self._sums

    def tokens_before(self, position: int) -> int:
        """Tokens of the whole pieces that end at ``position`` or before."""
        leaf, offset, tokens = self._find(position)
        for part, n in zip(self._leaves[leaf], self._tokens[leaf]):
            offset += len(part)
            if offset > position:
                break
            tokens += n
        return tokens

    def _find(self, position: int) -> tuple[int, int, int]:
        """The leaf that holds a position, the leaf's own position, and the tokens before it."""
        node, offset, tokens = 1, 0, 0
        while node < self._width:
            node *= 2
            if offset + self._chars[node] <= position and self._chars[node + 1]:
                offset += self._chars[node]
                tokens += self._sums[node]
                node += 1
        return node - self._width, offset, tokens

    def replace(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start`` on, both moved into the text."""
        start = min(max(start, 0), self.n_chars)
        end = min(start + max(length, 0), self.n_chars)
        # A boundary is sure if the characters on its both sides stay, and the one before
        # these: a line break that another white character joins is no longer alone.
        first, first_piece, left = self._boundary_before(start - 1)
        last, last_piece, right = self._boundary_after(end + 2)
        old = self._between(first, first_piece, last, last_piece)
        new = old[: start - left] + replacement + old[end - left :]
        assert right - left == len(old)
        parts = pieces(new)
        self.counted += len(new)
        tokens = self._bpe.counts(parts)
        leaves = [self._leaves[first][:first_piece] + parts + self._leaves[last][last_piece:]]
        counts = [self._tokens[first][:first_piece] + tokens + self._tokens[last][last_piece:]]
        touched = last - first + 1
        if touched == 1 and len(leaves[0]) <= SPLIT:
            self._leaves[first], self._tokens[first] = leaves[0], counts[0]
            self._correct(first)
            return
        if len(leaves[0]) > SPLIT:
            starts = range(0, len(leaves[0]), LEAF)
            leaves, counts = [[x[0][i : i + LEAF] for i in starts] for x in (leaves, counts)]
        if len(leaves) <= touched:
            for i in range(touched):
                inside = i < len(leaves)
                self._leaves[first + i] = leaves[i] if inside else []
                self._tokens[first + i] = counts[i] if inside else []
                self._correct(first + i)
            return
        self._leaves[first : last + 1] = leaves
        self._tokens[first : last + 1] = counts
        self._sum_up()

    def _correct(self, leaf: int) -> None:
        node = leaf + self._width
        self._chars[node], self._sums[node] = sum(map(len, self._leaves[leaf])), sum(self._tokens[leaf])
        while node > 1:
            node //= 2
            self._chars[node] = self._chars[2 * node] + self._chars[2 * node + 1]
            self._sums[node] = self._sums[2 * node] + self._sums[2 * node + 1]

    def _boundary_before(self, position: int) -> tuple[int, int, int]:
        """Leaf, piece and position of the last piece that begins before ``position``."""
        if position <= 0:
            return 0, 0, 0
        leaf, offset, _ = self._find(position - 1)
        for i, part in enumerate(self._leaves[leaf]):
            if offset + len(part) >= position:
                return leaf, i, offset
            offset += len(part)
        return leaf, len(self._leaves[leaf]), offset

    def _boundary_after(self, position: int) -> tuple[int, int, int]:
        """Leaf, piece and position of the first piece that begins at ``position`` or after; or the end."""
        if position >= self.n_chars:
            last = len(self._leaves) - 1
            return last, len(self._leaves[last]), self.n_chars
        leaf, offset, _ = self._find(position)
        for i, part in enumerate(self._leaves[leaf]):
            if offset >= position:
                return leaf, i, offset
            offset += len(part)
        return leaf, len(self._leaves[leaf]), offset

    def _between(self, first: int, first_piece: int, last: int, last_piece: int) -> str:
        if first == last:
            return "".join(self._leaves[first][first_piece:last_piece])
        inner = [part for leaf in self._leaves[first + 1 : last] for part in leaf]
        return "".join([*self._leaves[first][first_piece:], *inner, *self._leaves[last][:last_piece]])


# ---------------------------------------------------------------------- tables


def _numbers(values: list[int]) -> bytes:
    return np.array(values, "<u4").tobytes()


_TREE = "doc_id long, text string, n_tokens long, piece_chars binary, piece_tokens binary, node_chars array<long>, node_tokens array<long>"


def token_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text, n_tokens`` and the tree of each of ``docs`` (``doc_id, text``).

    ``piece_chars`` and ``piece_tokens`` are little-endian unsigned 32-bit numbers, one a
    piece; ``node_chars`` and ``node_tokens`` the sums of the nodes. Keep the table to
    count later edits with ``edited_counts``.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                parts = pieces(text.as_py())
                tokens = bpe.counts(parts)
                chars, sums = TokenTree.from_pieces(parts, tokens, bpe).node_sums()
                rows.append((sums[1], _numbers(list(map(len, parts))), _numbers(tokens), chars, sums))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["n_tokens", "piece_chars", "piece_tokens", "node_chars", "node_tokens"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "text", *names],
            )

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(grow, _TREE)


_EDITED = (
    "doc_id long, n_chars long, n_tokens long, n_edits long, edited_chars long, edited_tokens long, "
    "encoded_chars long, edited_text string"
)
_FIELDS = [f.split() for f in _EDITED.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _FIELDS]
    types = [pa.string() if kind == "string" else pa.int64() for _, kind in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[n for n, _ in _FIELDS])


class _Edited:
    """A document under edits, and its row of the result."""

    def __init__(self, doc_id: int | None, text: str, lengths: bytes, tokens: bytes, bpe: Encoder):
        self.doc_id, self.tree, self.n = doc_id, TokenTree.stored(text, lengths, tokens, bpe), 0
        self.before = self.tree.n_chars, self.tree.n_tokens

    def apply(self, start: int | None, length: int | None, replacement: str | None) -> None:
        self.tree.replace(start or 0, length or 0, replacement or "")
        self.n += 1

    def row(self) -> tuple:
        tree = self.tree
        return (self.doc_id, *self.before, self.n, tree.n_chars, tree.n_tokens, tree.counted, tree.text())


def edited_counts(trees: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """Apply to each row of ``trees`` its ``edits``: an array of ``start, length, replacement`` or null.

    Gives ``doc_id, n_chars, n_tokens`` as they were, ``n_edits``, ``edited_chars`` and
    ``edited_tokens`` afterwards, ``encoded_chars``, the characters that were encoded
    for it, and ``edited_text``. Nothing is shuffled.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            rows = []
            for *stored, changes in zip(*batch.columns):
                edited = _Edited(*(x.as_py() for x in stored), bpe)
                for change in changes.as_py() or []:
                    edited.apply(change["start"], change["length"], change["replacement"])
                rows.append(edited.row())
            yield _batch(rows)

    shape = "array<struct<start:long,length:long,replacement:string>>"
    rows = trees.select("doc_id", "text", "piece_chars", "piece_tokens", edits.cast(shape).alias("edits"))
    return rows.mapInArrow(apply, _EDITED)


def edited_by_log(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """As ``edited_counts``, with the edits in a table ``doc_id, seq, start, length, replacement``.

    Edits of a document need the text that the earlier ones left, so they pass through
    one task, one after another behind their document: it holds a tree and a batch.
    """
    nothing = F.lit(None)
    changes = {"seq": "long", "start": "long", "length": "long", "replacement": "string"}
    stored = {"text": "string", "piece_chars": "binary", "piece_tokens": "binary"}
    first = trees.select(
        "doc_id", F.lit(0).alias("kind"), *stored, *[nothing.cast(t).alias(c) for c, t in changes.items()]
    )
    then = edits.select(
        F.col("doc_id").cast("long"), F.lit(1).alias("kind"),
        *[nothing.cast(t).alias(c) for c, t in stored.items()], *[F.col(c).cast(t) for c, t in changes.items()],
    )
    order = ["doc_id", "kind", *changes]
    rows = first.unionByName(then).repartition("doc_id").sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        current, open_ = None, []
        for batch in batches:
            done = []
            for doc_id, kind, text, lengths, tokens, _, *change in zip(*(c.to_pylist() for c in batch.columns)):
                if doc_id != current:
                    done += [edited.row() for edited in open_]
                    current, open_ = doc_id, []
                if kind == 0:
                    open_.append(_Edited(doc_id, text, lengths, tokens, bpe))
                else:
                    for edited in open_:
                        edited.apply(*change)
            yield _batch(done)
        yield _batch([edited.row() for edited in open_])

    return rows.mapInArrow(walk, _EDITED)
