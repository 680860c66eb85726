"""Near-duplicate documents by HyperMinHash over word shingles, verified on the full sets.

A document's set is its distinct runs of five words. Documents are linked when their
sets' Jaccard similarity reaches a threshold, and a component is what links connect.

1. *Sets and registers.* Documents with equal sets are one class from here on. A class
   has ``REGISTERS`` buckets; each keeps, of the smallest hash that falls into it, the
   number of leading zeros (6 bits) and the next 10 bits. A bucket without a hash
   counts on with the next hash function, as if its number had more leading zeros, so a
   bucket of two sets agrees with the probability of their Jaccard similarity whatever
   their sizes.
2. *Bands.* Four registers make the key of a band. With 24 bands, a pair at 0.85 has no
   key in common with a probability of 2e-8.
3. *Stars.* In each group of equal keys all members meet one hub, the class with most
   neighbours over all its keys, so many groups agree on it. Pairs whose estimated
   similarity is far below the threshold leave; the others are verified on their full
   sets. Components of these links are found.
4. *Rest.* Members of one group that are still in different components are compared with
   each other within tasks, in blocks of a bounded size, and verified there on their
   full sets. So no pair in a group is left out, but pairs that are connected already
   are skipped, and only links leave a task.

The estimate corrects for registers that agree by chance. Sets are compared as 64-bit
hashes of the shingles.

Results for odd input: a null text or one without words has an empty set, is linked
with nothing, and is a component of its own; fewer words than five make one shingle of
all of them; rows that repeat a ``doc_id`` are documents of one id, all with the answer
of their set's component; a null ``doc_id`` takes part, but is smallest only among nulls;
an empty table gives no rows; other columns are ignored. A long text is hashed in blocks.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text, written
from .components import connected_components
from .words import mixed, shingle_hashes, text_blocks, word_hashes

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS

# Hash functions by which buckets are filled before every bucket has one of its own.
ROUNDS = 3
_MANTISSA_BITS = 10

# Standard deviations below the threshold at which an estimate rules a pair out.
MARGIN = 5.0

# Members of a group, and shingles of all of these, that are one block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22

_U = np.uint64


# ------------------------------------------------------------------- registers


def _compressed(smallest: np.ndarray, round_: int) -> np.ndarray:
    """Leading zeros and the bits after the leading one of 64-bit hashes, as 16-bit registers."""
    exponent = np.frexp(smallest.astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, 15)
    after = smallest << np.minimum(zeros + 1, 63).astype(np.uint64)
    mantissa = after >> _U(64 - _MANTISSA_BITS)
    return ((np.uint64(16 * round_) + zeros.astype(np.uint64)) << _U(_MANTISSA_BITS) | mantissa).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each non-empty set of shingle hashes."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    open_ = np.ones((len(sets), REGISTERS), bool)
    for round_ in range(ROUNDS):
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return out
        hashes = mixed(np.concatenate([sets[i] for i in rows]), 1 + round_)
        owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
        smallest = np.full(len(rows) * REGISTERS, ~_U(0))
        np.minimum.at(smallest, owner * REGISTERS + (hashes % _U(REGISTERS)).astype(np.int64), mixed(hashes, 101))
        smallest = smallest.reshape(len(rows), REGISTERS)
        fill = open_[rows] & (smallest != ~_U(0))
        out[rows] = np.where(fill, _compressed(smallest, round_), out[rows])
        open_[rows] &= ~fill
    # What is still open belongs to small sets: a hash function for each register.
    for i in np.flatnonzero(open_.any(axis=1)):
        places = np.flatnonzero(open_[i])
        seeds = mixed(places.astype(np.uint64), 77)
        hashes = mixed(sets[i][None, :] ^ seeds[:, None], 4)
        out[i, places] = _compressed(hashes.min(axis=1), ROUNDS)
    return out


def agreement_by_chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The share of registers in which two disjoint sets of these sizes agree.

    A smallest hash lies in [x, 2x) with a known probability for each set, and
    there in one of 1,024 cells.
    """
    load_a, load_b = np.maximum(n_a, 1) / REGISTERS, np.maximum(n_b, 1) / REGISTERS
    chance = np.zeros(np.broadcast(load_a, load_b).shape)
    for zeros in range(16):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        chance += (np.exp(-load_a * low) - np.exp(-load_a * high)) * (np.exp(-load_b * low) - np.exp(-load_b * high))
    return chance / (1 << _MANTISSA_BITS)


def estimated(agreeing: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance."""
    chance = agreement_by_chance(n_a, n_b)
    return (agreeing / REGISTERS - chance) / (1 - chance)


def lowest_estimate(percent: int) -> float:
    j = percent / 100
    return j - MARGIN * float(np.sqrt(j * (1 - j) / REGISTERS))


# ------------------------------------------------------------------------ sets


def _sets(texts: list[str], shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The shingle sets of neighbouring texts, with the index of the first."""
    for first, block in text_blocks(texts):
        words, begins = word_hashes(block)
        yield first, [np.unique(shingle_hashes(words[a:b], shingle)) for a, b in zip(begins, begins[1:])]


def _arrow(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, n_shingles, class, registers``; the class is null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n_shingles", "class", "registers"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for first, sets in _sets(batch.column(2).to_pylist(), shingle):
                filled = [i for i, s in enumerate(sets) if len(s)]
                signed = dict(zip(filled, registers([sets[i] for i in filled])))
                yield _arrow(
                    [
                        batch.column(0).slice(first, len(sets)),
                        batch.column(1).slice(first, len(sets)),
                        [len(s) for s in sets],
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        [signed[i].tobytes() if i in signed else None for i in range(len(sets))],
                    ],
                    types,
                    names,
                )

    texts = docs.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), whole_text().alias("text"))
    return texts.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, class binary, registers binary")


def _text_hash() -> Column:
    """Tells rows of one ``doc_id`` apart, those without one among them."""
    return F.xxhash64(whole_text())


def _class_sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``class, shingles``: the full set of each of ``classes``, from one of its documents."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for first, sets in _sets(batch.column(0).to_pylist(), shingle):
                data = [s.tobytes() for s in sets]
                found = [hashlib.blake2b(d, digest_size=16).digest() for d in data]
                # Texts of one hash may belong to several classes.
                keep = [i for i, c in enumerate(found) if c == wanted[first + i]]
                yield _arrow([[found[i] for i in keep], [data[i] for i in keep]], [pa.binary()] * 2, ["class", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), whole_text().alias("text"))
    of_class = classes.select("doc_id", "text_hash", "class")
    same = texts["doc_id"].eqNullSafe(of_class["doc_id"]) & (texts["text_hash"] == of_class["text_hash"])
    found = texts.join(of_class, same).select("text", "class")
    sets = found.mapInArrow(collect, "class binary, shingles binary")
    return sets.groupBy("class").agg(F.first("shingles").alias("shingles"))


# ----------------------------------------------------------------------- pairs


def _estimate_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of pairs with registers and sizes whose estimate is not too low."""
    lowest = lowest_estimate(percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, of_a, of_b, n_a, n_b = batch.columns
            r_a, r_b = _matrix(of_a.to_pylist()), _matrix(of_b.to_pylist())
            n_a, n_b = n_a.to_numpy(), n_b.to_numpy()
            # Sizes alone bound the similarity.
            sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            good = sized & (estimated((r_a == r_b).sum(axis=1), n_a, n_b) >= lowest)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], names=["a", "b"])

    return pairs.select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(keep, "a binary, b binary")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), REGISTERS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for of_a, of_b in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(of_a.as_buffer(), np.uint64), np.frombuffer(of_b.as_buffer(), np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    of_a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("s_a"))
    of_b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("s_b"))
    joined = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "s_a", "s_b")
    return joined.mapInArrow(test, "a binary, b binary")


class _Group:
    """The members of two blocks of one key, and the pairs of them to look at."""

    def __init__(self, at: tuple, own: list, classes: list, n: list, regs: list, components: list):
        self.band, _, self.i, self.j = at
        self.own, self.classes, self.n = np.array(own), classes, np.array(n)
        self.regs = _matrix(regs)
        self.component = np.unique(np.array(components, object), return_inverse=True)[1]

    def pairs(self, percent: int, lowest: float) -> Iterator[tuple[int, np.ndarray]]:
        """A member, and those that it may be linked with in this key and no earlier one.

        Members of the two blocks meet each other; those of one block, the ones after.
        """
        for x in np.flatnonzero(self.own == self.i):
            others = np.flatnonzero(self.own == self.j) if self.i != self.j else np.arange(x + 1, len(self.own))
            others = others[self.component[others] != self.component[x]]
            n, other_n = self.n[x], self.n[others]
            others = others[100 * np.minimum(other_n, n) >= percent * np.maximum(other_n, n)]
            if not len(others):
                continue
            same = self.regs[others] == self.regs[x]
            first = same.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1) == self.band
            good = others[first & (estimated(same.sum(axis=1), self.n[others], n) >= lowest)]
            if len(good):
                yield x, good


_GROUP = ["band", "key", "i", "j"]
_MEMBER = [*_GROUP, "own", "class", "n", "registers", "component"]
_MEMBER_TYPES = "band int, key long, i int, j int, own int, class binary, n long, registers binary, component binary"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Group, list[tuple]] | None]:
    """Each group of rows sorted by ``_GROUP``, with its rows; None at the end of a batch."""
    current, rows = None, []

    def group() -> tuple[_Group, list[tuple]]:
        _, _, _, _, own, classes, n, regs, components, *_ = zip(*rows)
        return _Group(current, own, classes, n, regs, components), rows

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:4] != current:
                if len(rows) > 1:
                    yield group()
                current, rows = row[:4], []
            rows.append(row)
        yield None
    if len(rows) > 1:
        yield group()


def _rest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links ``a, b`` between members of equal key and different ``component``.

    ``rows`` has ``band, key, class, n, registers, component, members, shingles``. Members
    of a key are dealt into blocks, and a task sees two blocks of one key at a time.
    A first pass marks the members that have somebody to be compared with, a second
    one gets their full sets. Pairs live within a task: what leaves it are marked members,
    then links, and of these only such that join two components.
    """
    lowest = lowest_estimate(percent)
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = (
        rows.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .select(*_MEMBER)
    )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        for found in _groups(batches):
            if found:
                group, members = found
                marked = sorted({int(y) for x, others in group.pairs(percent, lowest) for y in (x, *others)})
                if marked:
                    yield _arrow(list(zip(*(members[y] for y in marked))), types, _MEMBER)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _groups(batches):
            if found:
                group, members = found
                full = [np.frombuffer(m[-1], np.uint64) for m in members]
                links = []
                for x, others in group.pairs(percent, lowest):
                    for y in others:
                        if group.component[x] == group.component[y]:
                            continue
                        common = len(np.intersect1d(full[x], full[y], assume_unique=True))
                        if 100 * common >= percent * (len(full[x]) + len(full[y]) - common):
                            group.component[group.component == group.component[y]] = group.component[x]
                            links.append((group.classes[x], group.classes[y]))
                if links:
                    yield _arrow(list(zip(*links)), [pa.binary()] * 2, ["a", "b"])

    def together(members: DataFrame) -> DataFrame:
        return members.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "class")

    marked = together(dealt).mapInArrow(mark, _MEMBER_TYPES)
    with_sets = marked.join(sets, "class").select(*_MEMBER, "shingles")
    return together(with_sets).mapInArrow(verify, "a binary, b binary")


# ------------------------------------------------------------------ components


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest ``doc_id`` that links reach, and ``kept`` marks it.
    """
    signed, of_class = _components(docs, percent, shingle)
    smallest = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    answers = of_class.join(smallest, "root").select("class", "component_id")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.join(answers, "class", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _components(docs: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and ``class, doc_id, root`` of each class with its smallest id."""
    signed = written(signatures(docs, shingle), "signatures")
    classes = written(
        signed.filter("class is not null")
        .groupBy("class")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("of"),
            F.first("n_shingles").alias("n"),
            F.first("registers").alias("registers"),
        )
        .select("class", "of.doc_id", "of.text_hash", "n", "registers"),
        "classes",
    )
    links = _links(docs, classes, percent, shingle)
    roots = connected_components(links).select(F.col("node").alias("class"), "root")
    of_class = classes.select("class", "doc_id").join(roots, "class", "left")
    return signed, of_class.select("class", "doc_id", F.coalesce("root", "class").alias("root"))


def _links(docs: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Verified links ``a, b`` between classes that connect the same classes as all links do."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    keyed = classes.select("class", "n", "registers", band).select(
        "class", "band", F.xxhash64("band", F.expr(f"substring(registers, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key")
    )
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    grouped = written(keyed.join(sizes, "key"), "groups")
    degrees = grouped.groupBy("class").agg(F.sum("members").alias("degree"))
    ranked = grouped.join(degrees, "class")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "class"))["class"].alias("hub"))
    stars = grouped.join(hubs, "key").filter("class != hub").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    stars = written(_estimate_filter(_with_registers(stars.distinct(), classes), percent), "star-pairs")
    involved = classes.join(degrees.select("class"), "class", "left_semi")
    sets = written(_class_sets(docs, involved, shingle), "sets")
    links = written(_verified(stars, sets, percent), "star-links")

    roots = connected_components(links).select(F.col("node").alias("class"), "root")
    placed = grouped.join(roots, "class", "left").withColumn("component", F.coalesce("root", "class")).drop("root")
    placed = placed.join(classes.select("class", "n", "registers"), "class")
    torn = placed.groupBy("key").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.sum("n").alias("shingles")
    )
    torn = torn.filter("_low != _high").select("key", "shingles")
    return links.unionByName(written(_rest(placed.join(torn, "key"), sets, percent), "rest-links"))


def _with_registers(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    of_a = classes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    of_b = classes.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    return pairs.join(of_a, "a").join(of_b, "b")


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component.

    That is the row of the smallest ``doc_id``, a null last, then of the smallest hash of the text; of rows
    alike in both one stays, whichever. So unlike texts under one ``doc_id``, or under none, both
    stay. Rows without words are linked with nothing: all stay.
    """
    signed, of_class = _components(docs, percent, shingle)
    placed = signed.filter("class IS NOT NULL").join(of_class.select("class", "root"), "class")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("of")
    kept = placed.groupBy("root").agg(first).select(F.col("of.doc_id").alias("_kept_id"), F.col("of.text_hash").alias("_kept_hash"))
    hashed = docs.withColumns({"_near_id": F.col("doc_id").cast("long"), "_near_hash": _text_hash()})
    has_words = whole_text().rlike(r"[^\x20\x09-\x0D]")
    same = F.col("_near_id").eqNullSafe(F.col("_kept_id")) & (F.col("_near_hash") == F.col("_kept_hash"))
    chosen = hashed.filter(has_words).join(kept, same, "left_semi").dropDuplicates(["_near_id", "_near_hash"])
    return chosen.select(*docs.columns).unionByName(docs.filter(~has_words))
