"""The registered queries of the operators: whole tables, production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat import conversation_digests, examples, format_turns
from .common import table, written
from .fuzzy_lines import repeated_lines
from .hard_negatives import hard_negatives
from .languages import identify_documents, identify_pages, trigram_counts
from .mixing import mix_sources
from .near_documents import near_duplicates
from .packing import pack_documents
from .quality_rules import judge, sql as quality_sql
from .search import search
from .spelling import spelling_variants
from .suffix_tree import score_documents
from .syncmers import fingerprint_documents
from .token_trees import edited_counts, token_trees


def op1_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and again after three edits: a cut, an insertion, a new beginning."""
    trees = token_trees(table(spark, sf_dir, "documents"))
    n = F.length("text").cast("long")
    edit = lambda start, length, replacement: F.struct(
        start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), replacement.alias("replacement")
    )
    note = F.concat(F.lit("[edit of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit("]\n"))
    edits = F.array(
        edit(F.floor(n / 3), 20, F.lit("")), edit(F.floor(2 * n / 3), 0, note), edit(F.lit(0), 5, F.lit("New: "))
    )
    edited = edited_counts(trees, edits)
    return edited.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")


def op2_bayesian_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and of every page, whose trigrams are those of the documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    answers = ["language", "probability", "text_language", "n_trigrams", "declared", "host", "rejected"]
    of_docs = identify_documents(docs, carry=["doc_id"])
    of_pages = identify_pages(pages, trigram_counts(docs), carry=["page_id"])
    nothing = F.lit(None).cast("long")
    return of_docs.select("row.doc_id", nothing.alias("page_id"), *answers).unionByName(
        of_pages.select(nothing.alias("doc_id"), "row.page_id", *answers)
    )


def op3_probabilistic_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a tree of six sevenths of them."""
    return score_documents(table(spark, sf_dir, "documents"))


def op4_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every document whose id is divisible by 50."""
    return search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op5_minhash_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, and where its component stands for the first time."""
    return repeated_lines(table(spark, sf_dir, "documents"))


def op6_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


# Conversation -7: both turns hold the strings that the template uses itself.
_CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op7_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and number -7, formatted and expanded to examples, written, read back and digested."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", _CONTROL_TEXT), (-7, 1, "assistant", _CONTROL_TEXT)], turns.schema
    )
    formatted = written(format_turns(turns.unionByName(extra)), "formatted")
    return conversation_digests(formatted, written(examples(formatted), "examples"))


def op8_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_weighted_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its source's target and the words that the mix takes of it."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc.doc_id", "size", "source_size", "target", taken)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for the positives of every row whose id is divisible by 50, with some labels moved on."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


# Every step of operator 11 on all pairs of an anchor and a row at once.
_HARD_NEGATIVES_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0),
scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS score
  FROM usable a, usable b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored WHERE same),
mined AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM positives p JOIN scored n ON p.ar = n.ar
  WHERE p.place <= 5 AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT CAST(anchor_id AS BIGINT) AS anchor_id, CAST(positive_id AS BIGINT) AS positive_id, CAST(rank AS INTEGER) AS rank,
       CAST(negative_id AS BIGINT) AS negative_id, CAST(positive_score AS BIGINT) AS positive_score,
       CAST(negative_score AS BIGINT) AS negative_score
FROM mined WHERE rank <= 3"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and the verdict of the table of rules."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("row.doc_id", *[c for c in judged.columns if c != "row"])


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents, its form and its root."""
    return spelling_variants(table(spark, sf_dir, "documents"))


_QUERIES = [op1_edit_aware_token_counts, op2_bayesian_language_id, op3_probabilistic_suffix_tree, op4_block_max_wand, op5_minhash_fuzzy_lines, op6_hyperminhash_near_dedup, op7_prefix_target_chat, op8_shortest_pack_first, op9_closed_syncmers, op10_weighted_fair_queueing, op11_hard_negatives, op12_quality_rules, op13_spelling_variants]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {op11_hard_negatives.__name__: _HARD_NEGATIVES_SQL, op12_quality_rules.__name__: quality_sql()}
