"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue: its documents in shuffled order, again from the start up to
``max_repeats`` times. Taking a document ends at a virtual time, the source's words up
to and including it divided by the source's target. Documents of all queues are taken
in the order of that finish time until the budget, a share of all words, is used up.
At any virtual time each source is then served in proportion to its target, and at
time 1 up to its target.

A source's words up to a document are a running total in chunks (``ranks``), so a
source may hold most of the rows. The cut is found on a histogram of finish times,
refined around the budget until few documents remain; these alone are sorted. The
driver sees sums of at most ``BINS`` bins and the totals of the water filling.

Results for odd input: a null text has size 0, and documents of size 0 are never
taken; null is a source of its own, the last; repeated rows are documents of their
own; an empty table gives no rows; null or repeated ``doc_id`` are allowed; columns of
any name pass through in ``doc``. Ties of finish times are broken by the shuffle. The document at the cut is taken if at least half of it fits.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import whole_text, written
from .ranks import chunk_count, global_ranks, hash_chunk, running_totals

# Weights of the sources in order, share of all words, most uses of a document.
WEIGHTS, SHARE, MAX_REPEATS = (1, 2, 3), 1.0, 3

# Bins of a histogram of finish times, and documents that are sorted at the cut.
BINS, SORTED = 1024, 10_000


def word_count(text: Column) -> Column:
    """Words are what stands between spaces, tabs and line ends; null has none."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """Add ``target`` to a written table of ``_key, source, source_size``, one row a source.

    Sources in the order of their names' code points, null last, get ``weights`` in
    turn. No target is above ``max_repeats`` times its source; what is left over goes to the
    others by weight until none is above.
    """
    ranked = written(global_ranks(sources, F.col("source").asc_nulls_last(), "_rank"), "ranked-sources")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int"))
    weighted = ranked.withColumns({"_weight": weight, "_most": max_repeats * F.col("source_size")})
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        below = F.col("_most") <= F.lit(level) * F.col("_weight")
        full, open_weight = weighted.agg(
            F.sum(F.when(below, F.col("_most"))), F.sum(F.when(~below, F.col("_weight")))
        ).first()
        raised = (share * total - (full or 0)) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("_most").cast("double"), F.lit(level) * F.col("_weight"))
    return weighted.select("_key", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: int = 0,
    carry: list[str] | None = None,
) -> DataFrame:
    """``doc, size, source_size, target, copies`` for every row of ``docs`` (``doc_id, text, source``).

    ``doc`` is the row as it came, or its columns ``carry``, which are shuffled and
    written with it; ``copies`` is how often the mix takes it.
    """
    queued = written(
        docs.select(
            F.struct(*(carry or ["*"])).alias("doc"),
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("_order"),
        ),
        "sized",
    )
    sources = queued.groupBy("_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")
    )
    sources = written(sources, "sources")
    n_rows, total = sources.agg(F.sum("n"), F.sum("source_size")).first()
    targets = source_targets(sources, weights, share, max_repeats)
    chunk, order = hash_chunk("_order", chunk_count(n_rows or 0)), ["_order", "doc_id", "size"]

    def drawn(rows: DataFrame) -> DataFrame:
        return running_totals(rows, ["_key"], chunk, order, F.col("size"), targets)

    # The cut is found without the documents, which are dealt once, for the result, and not written again.
    drawn_sizes = written(drawn(queued.select("_key", "doc_id", "size", "_order")), "drawn")
    uses = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    taken = (
        drawn_sizes.filter("size > 0 and target > 0")
        .select("size", "_order", "source_size", "target", "through", uses.alias("_use"))
        .withColumn("_finish", _finish(F.col("_use")))
    )
    cut = _cut(taken, share * (total or 0))
    copies = sum(
        (F.when(_up_to(_finish(F.lit(use)), F.lit(use), cut), 1).otherwise(0) for use in range(max_repeats)),
        start=F.lit(0),
    )
    usable = F.coalesce((F.col("size") > 0) & (F.col("target") > 0), F.lit(False))
    return drawn(queued).select("doc", "size", "source_size", "target", F.when(usable, copies).otherwise(0).alias("copies"))


def _finish(use: Column) -> Column:
    return (use * F.col("source_size") + F.col("through")) / F.col("target")


def _up_to(finish: Column, use: Column, cut: tuple | None) -> Column:
    """Is a use taken before the cut, or the last one taken?"""
    if cut is None:
        return F.lit(True)
    at, order, last_use = map(F.lit, cut)
    tied = (F.col("_order") < order) | ((F.col("_order") == order) & (use <= last_use))
    return (finish < at) | ((finish == at) & tied)


def _cut(taken: DataFrame, budget: float) -> tuple | None:
    """``finish, order, use`` of the last document taken; None if the budget takes all."""
    low, high, n = taken.agg(F.min("_finish"), F.max("_finish"), F.count("*")).first()
    if not n:
        return None
    used, place, within = 0, F.col("_finish"), taken
    while n > SORTED and low < high:
        width = (high - low) / BINS
        bin_ = F.least(F.floor((place - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        sums = within.groupBy(bin_.alias("bin")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n"), F.min("_finish").alias("low"), F.max("_finish").alias("high")
        )
        found = None
        for found in sorted(sums.collect(), key=lambda r: r["bin"]):
            if used + found["size"] > budget:
                break
            used += found["size"]
        else:
            return None
        low, high, n = found["low"], found["high"], found["n"]
        within = taken.filter(place.between(low, high))
    # Few are left, unless that many finish at the very same time.
    by_time = Window.orderBy("_finish", "_order", "_use").rowsBetween(Window.unboundedPreceding, 0)
    fits = within.withColumn("_through", F.sum("size").over(by_time) + F.lit(used)).filter(
        F.col("_through") - F.col("size") / 2 <= F.lit(budget)
    )
    last = fits.orderBy(F.desc("_finish"), F.desc("_order"), F.desc("_use")).first()
    if last is None:
        return (low, -(1 << 63), -1)
    return (last["_finish"], last["_order"], last["_use"])


def mixed_documents(mixed: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, none of size 0."""
    repeated = F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc")
    return mixed.filter("copies > 0").select(repeated).select("doc.*")
