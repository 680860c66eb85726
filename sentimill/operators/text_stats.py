"""Term statistics as relations: what the classifier computes on hashed terms,
here per real term (A4, A5). One row of the input is one document, as in the
classifier.
"""

from pyspark.ml.feature import Tokenizer
from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_path

# A vocabulary up to this size is broadcast whole.
BROADCAST_BYTES = 64 << 20

# In the join with a larger one, no term keeps more than one in HOT_SHARE of all (document,
# term) pairs in one task, or one in four times the shuffle partitions if these are more.
HOT_SHARE = 4096


def tokens(df: DataFrame, text: str = "text", words: str = "words") -> DataFrame:
    """Add ``words``: lower-cased text split on each single whitespace (M1).

    Blank tokens are kept except at the end of the text.
    """
    return Tokenizer(inputCol=text, outputCol=words).transform(df)


def token_counts(df: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens``."""
    return tokens(df.select(doc_id, text), text).select(
        doc_id, F.size("words").cast("long").alias("n_tokens")
    )


def term_frequencies(df: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """``doc_id, term, tf``: how often each term occurs in each document (A4).

    Counts inside the row (sort the words, then measure the runs of equal
    words), so nothing is shuffled and no document needs a group.
    """
    words = tokens(df.select(doc_id, text), text).select(
        doc_id, F.sort_array("words").alias("words")
    )
    n = F.size("words")
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    starts = F.filter(
        positions, lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))
    )
    runs = F.transform(
        "starts",
        lambda start, k: F.struct(
            F.get("words", start).alias("term"),
            (F.coalesce(F.get("starts", k + 1), n) - start).cast("long").alias("tf"),
        ),
    )
    return (
        words.select(doc_id, "words", starts.alias("starts"))
        .select(doc_id, F.explode(runs).alias("run"))
        .select(doc_id, "run.term", "run.tf")
    )


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """``term, df``: in how many documents each term occurs (A5).

    Distinct terms are taken inside the row, so the only shuffle is one of
    counts already combined per task.
    """
    return _frequencies(df, text).filter("term is not null")


def _frequencies(df: DataFrame, text: str) -> DataFrame:
    """``term, df`` and, for the null term, the number of documents."""
    terms = F.array_append(F.array_distinct("words"), F.lit(None).cast("string"))
    return (
        tokens(df.select(text), text)
        .select(F.explode(terms).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def idf_weight(n_docs: Column, doc_freq: Column, min_doc_freq: int) -> Column:
    """``ln((n + 1) / (df + 1))``, 0 for terms in fewer than ``min_doc_freq`` documents."""
    return F.when(doc_freq >= min_doc_freq, F.log((n_docs + 1) / (doc_freq + 1))).otherwise(0.0)


def tf_idf(
    df: DataFrame, doc_id: str, text: str = "text", min_doc_freq: int = 10, path: str | None = None
) -> DataFrame:
    """``doc_id, term, tf, df, idf, tf_idf`` for every term of every document.

    Calling it writes the vocabulary with its document frequencies to ``path``, by
    default a new one in the shared folder; the result reads it, so the path must stay
    as long as the result is in use, and is the caller's to remove. A small vocabulary
    is broadcast. A large one meets the term counts, made once, in a join by term,
    where the rows of frequent terms are dealt to several tasks each.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, "document-frequencies")
    _frequencies(df, text).write.parquet(path)
    written = spark.read.parquet(path)
    doc_freq, in_all = written.filter("term is not null"), written.filter("term is null")
    size = doc_freq.agg(
        F.sum(F.octet_length("term") + 32).alias("bytes"), F.sum("df").alias("pairs")
    ).first()
    found = in_all.first()
    n_docs = F.lit(found["df"] if found else 0)

    tf = term_frequencies(df, doc_id, text)
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        weighted = tf.join(F.broadcast(doc_freq), "term")
    else:
        weighted = _joined_by_term(tf, doc_freq, doc_id, size["pairs"])
    return (
        weighted.withColumn("idf", idf_weight(n_docs, F.col("df"), min_doc_freq))
        .withColumn("tf_idf", F.col("tf") * F.col("idf"))
        .select(doc_id, "term", "tf", "df", "idf", "tf_idf")
    )


def _joined_by_term(tf: DataFrame, doc_freq: DataFrame, doc_id: str, n_pairs: int) -> DataFrame:
    """``tf`` with ``df``, by a shuffled join in which frequent terms are salted.

    Which terms are frequent is told to both sides by hash, so a term of any length
    costs the same few bytes, and fewer than the share allows can be that frequent.
    """
    shares = max(HOT_SHARE, 4 * int(tf.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salts = F.ceil(F.max("df") * F.lit(shares / n_pairs))
    hot = F.broadcast(
        doc_freq.filter(F.col("df") > F.lit(n_pairs / shares))
        .groupBy(F.xxhash64("term").alias("_hash"))
        .agg(salts.alias("_salts"))
    )
    dealt = (
        tf.withColumn("_hash", F.xxhash64("term"))
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(doc_id, "tf"), F.col("_salts")), F.lit(0)))
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts") - 1, F.lit(0).cast("long"))))
    repeated = (
        doc_freq.withColumn("_hash", F.xxhash64("term"))
        .join(hot, "_hash", "left")
        .select("term", "df", every.alias("_salt"))
    )
    return dealt.join(repeated.hint("merge"), ["term", "_salt"])
