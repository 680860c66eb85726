"""Packing documents into token sequences: shortest pack first over the length histogram.

A document is its token ids and one end id. It is cut after every ``max_length`` ids,
so only its last piece is shorter. Packing looks at the histogram of the piece
lengths alone, at most ``max_length`` numbers: lengths are placed longest first, each
on the shortest pack that still has room, and all packs with the same content are one
pattern with a count. Patterns then go back to the pieces by the rank of a piece
among those of its length, so no piece is moved to where another one is.

Results for odd input: a null or empty text is the end id alone; an empty table gives
no pieces; repeated rows are packed once each, under the same ``doc_id``; a null
``doc_id`` stays null; other columns of the input are ignored, whatever their names.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import VOCABULARY, encoder
from .common import whole_text, written
from .ranks import chunk_count, hash_chunk, running_totals

MAX_LENGTH = 1024

# Fixed value: the id after each document.
END = (0).to_bytes(4, "little")

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def document_pieces(
    docs: DataFrame, max_length: int = MAX_LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = False
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids``: the cut documents.

    Ids are little-endian unsigned 32-bit numbers. One row at a time is tokenised.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.ids(text.as_py()) + END
                n = len(ids) // 4
                for start in range(0, n, max_length):
                    part = ids[4 * start : 4 * (start + max_length)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 5, pa.binary()])]
                if rows
                else [pa.array([], t) for t in [*[pa.int64()] * 5, pa.binary()]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    pieces = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(cut, _PIECES)
    return pieces if with_ids else pieces.drop("ids")


def pack_histogram(counts: dict[int, int], max_length: int = MAX_LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack, how many such packs) for ``counts`` of each length.

    As if pieces were placed one by one, but all equal steps at once: the work
    depends on the number of lengths, not of pieces.
    """
    # Patterns by the room they have left; the most room is the shortest pack.
    by_room: dict[int, list[list]] = defaultdict(list)

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if count:
            by_room[room].append([pattern, count])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=-1)
            if room < length:
                each = max_length // length
                full, rest = divmod(left, each)
                put((length,) * each, full, max_length - each * length)
                put((length,) * rest, 1 if rest else 0, max_length - rest * length)
                break
            pattern, count = by_room[room].pop()
            placed = min(left, count)
            put(pattern, count - placed, room)
            put((*pattern, length), placed, room - length)
            left -= placed
    return [(pattern, count) for room in sorted(by_room) for pattern, count in by_room[room]]


def pattern_slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, count, first sequence, offset`` of each place of each pattern."""
    slots, next_rank, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            slots.append((length, next_rank[length], count, sequence, offset))
            next_rank[length] += count
            offset += length
        sequence += count
    return slots


def pack_pieces(pieces: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Add ``sequence_id, offset`` to a written table of pieces.

    The histogram, at most ``max_length`` rows, is all that the driver sees; the
    places it returns are a few for each length.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pattern_slots(pack_histogram(histogram, max_length))
    places = spark.createDataFrame(
        slots, "_length long, _first long, _count long, _sequence long, _offset long"
    )
    row = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    keyed = pieces.withColumn("_order", F.xxhash64(*row))
    chunk = hash_chunk("_order", chunk_count(sum(histogram.values())))
    ranked = running_totals(keyed, ["length"], chunk, ["_order", *row], F.lit(1))
    nth = F.col("before") - F.col("_first")
    at = (F.col("length") == F.col("_length")) & (nth >= 0) & (nth < F.col("_count"))
    return ranked.join(F.broadcast(places), at).select(
        *pieces.columns, (F.col("_sequence") + nth).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def pack_documents(
    docs: DataFrame, max_length: int = MAX_LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = False
) -> DataFrame:
    """The pieces of all ``docs`` (``doc_id, text``) with the sequence and offset of each."""
    return pack_pieces(written(document_pieces(docs, max_length, vocabulary, with_ids), "pieces"), max_length)


def assemble(packed: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the sequences themselves, from pieces packed with their ids.

    Filled up with the end id to ``max_length``, except where ``n_tokens`` is a power
    of two. A group is one sequence.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda ids, part: F.concat(ids, part["ids"]))
    n = F.col("n_tokens")
    padded = F.rpad("ids", F.lit(4 * max_length), F.lit(END))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
        .withColumn("ids", F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(padded))
    )
