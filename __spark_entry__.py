"""

The driver tables hold no app reviews, so documents stand in for them: a document
is the review text, and the date, version and rating follow from ``doc_id``. Its label is
``labels.quality``, or follows from ``doc_id`` for the documents without one; only
training is confined to documents with a label. Every query runs over the whole of its
tables.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import sentimill as sm
from sentimill.functions import raw_review_hour, review_date
from sentimill.operators.releases import DEFAULT_RELEASES
from sentimill.session import shared_path

try:
    import corpus_pipeline
    from sentimill.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    # Both may be left out of an installation; anything else that is missing is an error.
    if missing.name not in ("corpus_pipeline", "sentimill.llm"):
        raise
    corpus_pipeline = llm_queries = None

# ---------------------------------------------------------------- input frames


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir) -> DataFrame:
    return sm.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _rated(spark, sf_dir) -> DataFrame:
    """``doc_id, text, quality`` of all documents; Spark picks the join from the sizes it finds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("_quality"))
    quality = F.coalesce("_quality", (F.col("doc_id") % 2).cast("int"))
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", quality.alias("quality"))


def _labelled(spark, sf_dir) -> DataFrame:
    """``doc_id, text, quality`` of the documents with a label, for training."""
    docs = _documents(spark, sf_dir)
    return docs.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def _one_line() -> Column:
    return F.replace("text", F.lit("\n"), F.lit(" "))


def _review_date_text() -> Column:
    """A day of 2008 to 2017, written ``mar 05 2016``."""
    day = F.date_add(F.lit(date(2008, 1, 1)), F.pmod(F.col("doc_id") * 37, F.lit(3653)).cast("int"))
    text = F.date_format(day, "MMM dd yyyy")
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def _review_lines(rows: DataFrame, rating: Column, body: Column) -> DataFrame:
    """``date,version,rating,body`` lines; the space at the end makes a body blank, not missing."""
    version = F.concat((F.col("doc_id") % 5).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"))
    line = F.concat(
        _review_date_text(), F.lit(","), version, F.lit(","), rating.cast("string"), F.lit(","), body, F.lit(" ")
    )
    return rows.select(line.alias("value"))


def _rated_lines(spark, sf_dir) -> DataFrame:
    rating = F.when(F.col("quality") == 1, F.col("doc_id") % 3 + 3).otherwise(F.col("doc_id") % 2 + 1)
    return _review_lines(_rated(spark, sf_dir), rating, _one_line())


def _quoted_lines(spark, sf_dir) -> DataFrame:
    """``"id","25/8/2016 08:49:14","text","Positive","user7"`` lines."""
    minutes = F.pmod(F.col("doc_id") * 7919, F.lit(5260320))
    day = F.date_add(F.lit(date(2008, 1, 1)), F.floor(minutes / 1440).cast("int"))
    minute = (minutes % 1440).cast("int")
    clock = F.format_string("%02d:%02d:%02d", F.floor(minute / 60), minute % 60, F.col("doc_id") % 60)
    when = F.concat(F.date_format(day, "d/M/yyyy"), F.lit(" "), clock)
    mood = F.when(F.col("quality") == 0, "Negative").when(F.col("doc_id") % 2 == 0, "neutral").otherwise("Positive")
    user = F.concat(F.lit("user"), (F.col("doc_id") % 97).cast("string"))
    fields = [F.col("doc_id").cast("string"), when, _one_line(), mood, user]
    line = F.concat(F.lit('"'), F.concat_ws('","', *fields), F.lit('"'))
    return _rated(spark, sf_dir).select(line.alias("value"))


def _training_rows(spark, sf_dir) -> DataFrame:
    return _labelled(spark, sf_dir).select(
        "doc_id", F.col("text").alias("review"), F.col("quality").cast("double").alias("label")
    )


# Release dates for the driver tables, whose dates lie outside the default calendar.
MONTHLY_2024 = [date(2024, m, 10) for m in range(1, 13)]
QUARTERLY = [date(y, m, d) for y in range(1990, 2011) for m, d in ((3, 13), (5, 22), (8, 21), (11, 13))]

# --------------------------------------------------------------------- queries


def ingest_quoted_lines(spark, sf_dir) -> DataFrame:
    """P1, P2, P3, B1."""
    return sm.ingest(_quoted_lines(spark, sf_dir)).select(sm.basic_line().alias("line"))


def ingested_files(spark, sf_dir) -> DataFrame:
    """S1, K1, B1 from file to file."""
    raw, target = shared_path(spark, "raw"), shared_path(spark, "ingested")
    sm.write_lines(_quoted_lines(spark, sf_dir), raw)
    sm.run_ingest(spark, raw, target)
    return sm.read_lines(spark, target).select(F.col("value").alias("line"))


def legacy_features(spark, sf_dir) -> DataFrame:
    """B2b with P7b, P7c, J1: raw lines to feature rows."""
    return sm.build_features_legacy(sm.ingest(_quoted_lines(spark, sf_dir)), sm.default_releases(spark))


def parse_review_fields(spark, sf_dir) -> DataFrame:
    """Trimmed fields, the body cut at its first comma, blank bodies left out."""
    rating = F.col("doc_id") % 5 + 1
    return sm.with_body(sm.parse_review_lines(_review_lines(_documents(spark, sf_dir), rating, _one_line())))


def blank_reviews_removed(spark, sf_dir) -> DataFrame:
    """F1 where every seventh body starts with blanks and a comma."""
    blank = F.when(F.col("doc_id") % 7 == 0, " \t,").otherwise("")
    lines = _review_lines(_documents(spark, sf_dir), F.col("doc_id") % 5 + 1, F.concat(blank, _one_line()))
    return sm.with_body(sm.parse_review_lines(lines))


def review_dates(spark, sf_dir) -> DataFrame:
    """P5."""
    text = _documents(spark, sf_dir).select("doc_id", _review_date_text().alias("date_text"))
    return text.select("doc_id", "date_text", review_date("date_text").alias("review_date"))


def release_years(spark, sf_dir) -> DataFrame:
    """A3: the order dates as a release calendar."""
    dates = _table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("release"))
    days = F.transform("releases", lambda d: d.cast("string"))
    return sm.releases_by_year(dates).select(
        "year", F.size("releases").cast("long").alias("n_releases"), F.array_join(days, " ").alias("releases")
    )


def release_file(spark, sf_dir) -> DataFrame:
    """S3: the order dates written as ``M/d/yyyy`` lines and read as a calendar."""
    path = shared_path(spark, "calendar")
    days = _table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "M/d/yyyy"))
    sm.write_lines(days, path)
    return sm.read_releases(spark, path).groupBy("release").agg(F.count("*").alias("n_lines"))


def after_release_events(spark, sf_dir) -> DataFrame:
    """J1 over events."""
    events = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("date"))
    return sm.with_after_release(events, sm.release_calendar(spark, MONTHLY_2024))


def after_release_orders(spark, sf_dir) -> DataFrame:
    """J1 over orders."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return sm.with_after_release(orders, sm.release_calendar(spark, QUARTERLY))


def after_release_shipments(spark, sf_dir) -> DataFrame:
    """J1 with a calendar from the data: the first order day of each quarter, of two years in three.

    Items shipped in the other years are left out.
    """
    day = F.col("o_orderdate").cast("date")
    orders = _table(spark, sf_dir, "orders").select(day.alias("day"))
    calendar = (
        orders.groupBy(F.year("day").alias("year"), F.quarter("day").alias("quarter"))
        .agg(F.min("day").alias("release"))
        .filter("year % 3 != 0")
        .select("release")
    )
    shipped = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date")
    )
    return sm.with_after_release(shipped, calendar, on_error="drop")


def rating_labels(spark, sf_dir) -> DataFrame:
    """P7."""
    rating = (F.col("l_quantity").cast("int") % 5 + 1).cast("string")
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rating.alias("rating"))
    return items.withColumn("label", sm.rating_label("rating"))


def sentiment_labels(spark, sf_dir) -> DataFrame:
    """P7b, P7c."""
    word = F.when(F.col("event_type") == "purchase", "Positive").when(F.col("event_type") == "view", "NEUTRAL")
    events = _table(spark, sf_dir, "events").select(
        "event_id",
        F.coalesce(word, F.col("event_type")).alias("word"),
        F.date_format("ts", "d/M/yyyy HH:mm:ss").alias("written"),
    )
    return events.select(
        "event_id", sm.sentiment_label("word").alias("label"), raw_review_hour("written").cast("string").alias("version")
    )


def build_features(spark, sf_dir) -> DataFrame:
    """B2."""
    return sm.build_features(_rated_lines(spark, sf_dir), sm.default_releases(spark))


def feature_lines(spark, sf_dir) -> DataFrame:
    """P8."""
    return build_features(spark, sf_dir).select(sm.feature_line().alias("line"))


def written_feature_lines(spark, sf_dir) -> DataFrame:
    """Feature lines through the text sink and back."""
    path = shared_path(spark, "feature-lines")
    sm.write_lines(feature_lines(spark, sf_dir), path)
    return sm.read_object_lines(spark, path).select(F.col("value").alias("line"))


def written_features(spark, sf_dir) -> DataFrame:
    """K3: feature rows through the typed sink and back."""
    path = shared_path(spark, "features")
    sm.write_records(build_features(spark, sf_dir), path)
    return sm.read_records(spark, path, sm.schemas.FEATURES)


def header_csv(spark, sf_dir) -> DataFrame:
    """Feature rows as CSV with a header, the types inferred."""
    path = shared_path(spark, "header-csv")
    build_features(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return sm.read_header_csv(spark, path, escape='"')


def training_rows(spark, sf_dir) -> DataFrame:
    """P9."""
    return sm.parse_training_lines(feature_lines(spark, sf_dir), line="line")


def training_file(spark, sf_dir) -> DataFrame:
    """Training rows from a file of feature lines."""
    path = shared_path(spark, "training")
    sm.write_lines(feature_lines(spark, sf_dir), path)
    return sm.read_training_rows(spark, path)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    """Other settings for a while, those not set before taken away again."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def object_lines_with_blanks(spark, sf_dir) -> DataFrame:
    """Files of whole texts with empty lines inside and at their ends; how often each line comes.

    A document gives its text, an empty line, its text with ``\\r`` behind it, two empty lines and its
    number; each of 16 files ends with three empty lines. Files are read in splits of 64 KB, many to
    a task: a task and a staged file for each of them would cost more than their lines.
    """
    path = shared_path(spark, "blank-lines")
    number = F.col("doc_id").cast("string")
    body = F.concat("text", F.lit("\n\n"), "text", F.lit("\r\n\n\n"), number)
    rows = _table(spark, sf_dir, "documents").select(body.alias("value"), (F.col("doc_id") % 16).alias("part"))
    parts = spark.range(16).select(F.lit("\n\n").alias("value"), F.col("id").alias("part"))
    # The files' last lines, empty, sort behind all others.
    files = rows.withColumn("last", F.lit(0)).unionByName(parts.withColumn("last", F.lit(1)))
    sm.write_lines(files.repartition(16, "part").sortWithinPartitions("last").select("value"), path)
    with _conf(spark, {
        "spark.sql.files.maxPartitionBytes": "64k",
        "spark.sql.files.maxPartitionNum": str(8 * spark.sparkContext.defaultParallelism),
    }):
        lines = sm.read_object_lines(spark, path)
    return lines.groupBy("value").agg(F.count("*").alias("n"))


def _spoiled(good: Column, *bad: str) -> Column:
    """``good``, or one of ``bad`` lines for some documents, in turn."""
    spoiled = F.when(F.col("doc_id") % 10 == 0, F.lit(bad[0]))
    for i, text in enumerate(bad[1:], 1):
        spoiled = spoiled.when(F.col("doc_id") % 10 == i, F.lit(text))
    return spoiled.otherwise(good)


def _spoiled_quoted_lines(spark, sf_dir) -> DataFrame:
    line = F.concat(F.lit('"'), F.concat_ws('","', F.col("doc_id").cast("string"), F.lit("day"), _one_line(), F.lit("neutral")))
    spoiled = _spoiled(line, '"1","2","3"', "", "no separator")
    return _table(spark, sf_dir, "documents").select(spoiled.alias("value"))


def _spoiled_review_lines(spark, sf_dir) -> DataFrame:
    """Review lines with the document's number as version, so that it comes back."""
    number, rating = F.col("doc_id").cast("string"), (F.col("doc_id") % 5 + 1).cast("string")
    line = F.concat(_review_date_text(), F.lit(","), number, F.lit(","), rating, F.lit(","), _one_line(), F.lit(" "))
    spoiled = _spoiled(
        line, "mar 14 2016,1,4", "mar 14 2016,1,4.5,x", "14 mar 2016,1,4,x", "mar 14 1999,1,4,x", "mar 14 2016,1,4, "
    )
    return _table(spark, sf_dir, "documents").select(spoiled.alias("value"))


def _spoiled_training_lines(spark, sf_dir) -> DataFrame:
    text, number = F.replace(_one_line(), F.lit(","), F.lit(";")), F.col("doc_id").cast("string")
    label = (F.col("doc_id") % 2).cast("string")
    line = F.concat(text, F.lit(",TRUE,"), number, F.lit(","), label)
    spoiled = _spoiled(line, "text,true,1", "text,true,1,one", "")
    return _table(spark, sf_dir, "documents").select(spoiled.alias("value"))


def ingest_dropping_short_lines(spark, sf_dir) -> DataFrame:
    """B1, P1, P2 under ``drop``: lines of fewer than four fields are left out."""
    return sm.ingest(_spoiled_quoted_lines(spark, sf_dir), on_error="drop")


def features_dropping_bad_lines(spark, sf_dir) -> DataFrame:
    """B2 under ``drop``: short lines, bad ratings, bad dates and unknown years are left out."""
    return sm.build_features(_spoiled_review_lines(spark, sf_dir), sm.default_releases(spark), on_error="drop")


def training_dropping_bad_lines(spark, sf_dir) -> DataFrame:
    """P9 under ``drop``: short lines and labels that are no number are left out."""
    return sm.parse_training_lines(_spoiled_training_lines(spark, sf_dir), on_error="drop")


def rejected_records(spark, sf_dir) -> DataFrame:
    """B1, B2, B3 under ``drop``, from file to file: the lines that each job leaves out, by rule and text.

    From the jobs' quarantine folders; ``n_reported`` is what the job has told of the rule.
    """
    found = None
    for job, lines in (
        ("ingest", _spoiled_quoted_lines(spark, sf_dir)),
        ("features", _spoiled_review_lines(spark, sf_dir)),
        ("training", _spoiled_training_lines(spark, sf_dir)),
    ):
        source, target, bad = (shared_path(spark, f"{job}-{p}") for p in ("lines", "output", "rejected"))
        sm.write_lines(lines, source)
        told = {"on_error": "drop", "quarantine": bad, "report": {}}
        run = {"ingest": sm.run_ingest, "features": sm.run_features, "training": sm.run_train}[job]
        run(spark, source, target, **told, **({"blank_lines": "keep"} if job == "training" else {}))
        reported = F.create_map(*[F.lit(x) for pair in told["report"].items() for x in pair])
        one = sm.rejected_lines(spark, bad).groupBy("reason", "text").agg(F.count("*").alias("n"))
        one = one.select(F.lit(job).alias("job"), "*", reported[F.col("reason")].cast("long").alias("n_reported"))
        found = one if found is None else found.unionByName(one)
    return found


def token_counts(spark, sf_dir) -> DataFrame:
    """M1."""
    return sm.token_counts(_documents(spark, sf_dir), "doc_id")


def term_frequencies(spark, sf_dir) -> DataFrame:
    """A4."""
    return sm.term_frequencies(_documents(spark, sf_dir), "doc_id")


def term_doc_freq(spark, sf_dir) -> DataFrame:
    """A5."""
    return sm.document_frequencies(_documents(spark, sf_dir))


def term_tfidf(spark, sf_dir) -> DataFrame:
    """A4, A5 and the formula of M3 on real terms."""
    weights = sm.tf_idf(_documents(spark, sf_dir), "doc_id")
    return weights.withColumns({"idf": F.round("idf", 6), "tf_idf": F.round("tf_idf", 6)})


def hashed_tf(spark, sf_dir) -> DataFrame:
    """M2: the non-zero cells of every term vector."""
    return sm.hashed_counts(_documents(spark, sf_dir), "doc_id")


def idf_hashed(spark, sf_dir) -> DataFrame:
    """M3."""
    return sm.hashed_idf(_documents(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def idf_hashed_wide(spark, sf_dir) -> DataFrame:
    """M3 at the width of M5b."""
    wide = sm.hashed_idf(_documents(spark, sf_dir), num_features=sm.DEFAULT_PARAMS["num_features"])
    return wide.withColumn("idf", F.round("idf", 6))


def _document_batches(spark, sf_dir) -> list[DataFrame]:
    docs = _documents(spark, sf_dir)
    return [docs.filter(F.pmod("doc_id", F.lit(3)) == i) for i in range(3)]


def idf_of_merged_state(spark, sf_dir) -> DataFrame:
    """M3 from a table of states that three batches of documents were added to, the second one twice."""
    path = shared_path(spark, "bucket-states")
    for i, docs in enumerate(_document_batches(spark, sf_dir)):
        for _ in range(2 if i == 1 else 1):
            sm.add_to_state(sm.bucket_state(docs), path, f"batch-{i}")
    return sm.idf_of(sm.read_state(spark, path)).withColumn("idf", F.round("idf", 6))


def term_doc_freq_of_merged_state(spark, sf_dir) -> DataFrame:
    """A5 from a table of states: two batches compacted, and a third one merged with them."""
    path, compacted = shared_path(spark, "term-states"), shared_path(spark, "term-states")
    first, second, third = _document_batches(spark, sf_dir)
    sm.add_to_state(sm.term_state(first), path, "first")
    sm.add_to_state(sm.term_state(second), path, "second")
    sm.compact_state(spark, path, compacted)
    return sm.term_frequencies_of(sm.merged_state(sm.read_state(spark, compacted), sm.term_state(third)))


def _message_is_wrong() -> Column:
    word = F.when(F.col("prediction") == 1.0, "positive").when(F.col("prediction") == 0.0, "negative")
    return ~F.col("message").eqNullSafe(F.concat(F.lit("Sentiment is "), word))


def _answers(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(
        F.count("*").alias("n_reviews"), F.count_if(_message_is_wrong()).alias("n_wrong_messages")
    )


def train_and_score(spark, sf_dir) -> DataFrame:
    """Train, save, load, score; reviews and wrong messages of each label."""
    rows = _training_rows(spark, sf_dir)
    path = shared_path(spark, "model")
    sm.save_model(sm.train(rows), path)
    return _answers(sm.run_score(path, rows))


def train_default_variant(spark, sf_dir) -> DataFrame:
    """As ``train_and_score`` with Spark's default parameters, nothing saved."""
    rows = _training_rows(spark, sf_dir)
    return _answers(sm.score(sm.train(rows, **sm.DEFAULT_PARAMS), rows))


def _all_reviews(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).withColumnRenamed("text", "review")


def _probabilities(model, reviews: DataFrame, name: str) -> DataFrame:
    return model.transform(reviews).select("doc_id", vector_to_array("probability")[1].alias(name))


def saved_model_against_unsaved(spark, sf_dir) -> DataFrame:
    """K4, K5, M6: documents, and those that a model answers otherwise after saving and loading."""
    model, path = sm.train(_training_rows(spark, sf_dir)), shared_path(spark, "model")
    sm.save_model(model, path)
    scored = sm.load_model(path).transform(model.transform(_all_reviews(spark, sf_dir)).select(
        "doc_id", "review", vector_to_array("probability")[1].alias("p_unsaved")
    ))
    differs = ~vector_to_array("probability")[1].eqNullSafe(F.col("p_unsaved"))
    return scored.agg(F.count("*").alias("n_documents"), F.count_if(differs).alias("n_different"))


def replaced_model(spark, sf_dir) -> DataFrame:
    """K4, K5: a model saved over another one; documents of each answer's version, and wrong ones.

    The first is trained on the labels turned round. Documents are answered by what ``load_model`` finds
    after each save, and by the first version, asked for by its name after the second.
    """
    rows, path = _training_rows(spark, sf_dir), shared_path(spark, "model")
    turned, reviews = sm.train(rows.withColumn("label", 1 - F.col("label"))), _all_reviews(spark, sf_dir)
    straight = sm.train(rows)
    first = sm.save_model(turned, path)
    answers = [("first save", "turned", sm.load_model(path))]
    sm.save_model(straight, path)
    answers += [("second save", "straight", sm.load_model(path)), ("first version", "turned", sm.load_model(path, first))]
    # One pass over the reviews answers by all five models.
    scored = reviews
    for name, model in [("turned", turned), ("straight", straight), *((name, loaded) for name, _, loaded in answers)]:
        scored = model.transform(scored).select(*scored.columns, vector_to_array("probability")[1].alias(name))
    n_different = [F.count_if(~F.col(name).eqNullSafe(F.col(expected))) for name, expected, _ in answers]
    counts = scored.agg(F.count("*").alias("n"), *[n.alias(name) for n, (name, _, _) in zip(n_different, answers)])
    rows_of = [
        F.struct(F.lit(name).alias("loaded"), F.col("n").alias("n_documents"), F.col(name).alias("n_different"))
        for name, _, _ in answers
    ]
    return counts.select(F.inline(F.array(*rows_of)))


def predictions_recomputed(spark, sf_dir) -> DataFrame:
    """M2, M3, M4, M6: every answer again, from the hashed counts joined with the fitted weights.

    Documents, and those whose probability or prediction differs.
    """
    model = sm.train(_training_rows(spark, sf_dir))
    regression = model.stages[3]
    weights = spark.createDataFrame(
        [(i, float(w * v)) for i, (w, v) in enumerate(zip(regression.coefficients, model.stages[2].idf))],
        "bucket int, weight double",
    )
    docs = _documents(spark, sf_dir)
    sums = (
        sm.hashed_counts(docs, "doc_id").join(F.broadcast(weights), "bucket")  # a row for each bucket
        .groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("weight")).alias("z"))
    )
    scored = model.transform(docs.withColumnRenamed("text", "review")).select(
        "doc_id", vector_to_array("probability")[1].alias("p"), "prediction"
    )
    margin = F.coalesce("z", F.lit(0.0)) + F.lit(float(regression.intercept))
    again = 1 / (1 + F.exp(-margin))
    differs = (F.abs(again - F.col("p")) > 1e-9) | ((F.col("p") > 0.5) != (F.col("prediction") == 1.0))
    joined = scored.join(sums, "doc_id", "left")
    return joined.agg(F.count("*").alias("n_documents"), F.count_if(differs).alias("n_different"))


def _better_than_share(model, rows: DataFrame, name: str) -> DataFrame:
    p = F.when(F.col("label") == 1, vector_to_array("probability")[1]).otherwise(vector_to_array("probability")[0])
    share = F.avg("label")
    of_share = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    fitted = F.avg(-F.log(F.greatest(p, F.lit(1e-15))))
    return model.transform(rows).agg(
        F.lit(name).alias("variant"), F.count("*").alias("n_reviews"), (fitted < of_share).alias("better_than_share")
    )


def training_loss(spark, sf_dir) -> DataFrame:
    """Is the fitted loss below that of the best constant answer, in both variants?"""
    rows = _training_rows(spark, sf_dir)
    own = _better_than_share(sm.train(rows), rows, "own")
    defaults = _better_than_share(sm.train(rows, **sm.DEFAULT_PARAMS), rows, "defaults")
    return own.unionByName(defaults)


# The parameters of the own variant, until nothing is left to gain.
SETTLED = {"max_iter": 1000, "tol": 1e-12}

# Largest part of the gradient that a variant may end with.
GRADIENT_BOUNDS = {"own": 0.05, "defaults": 1e-4, "settled": 1e-6}


def fit_moments(spark, sf_dir) -> DataFrame:
    """M4, M5: every feature's moments, and is the settled fit's gradient along it zero?

    At the optimum the label's moment is the probability's, less the penalty.
    """
    rows = _training_rows(spark, sf_dir)
    of_features = sm.gradient_by_feature(sm.train(rows, **SETTLED), rows)
    return of_features.select(
        "bucket",
        *[F.round(c, 6).alias(c) for c in ("mean", "std", "label_moment")],
        (F.abs("gradient") <= GRADIENT_BOUNDS["settled"]).alias("at_optimum"),
    )


def fit_optimality(spark, sf_dir) -> DataFrame:
    """Rows and features that vary, is the objective over all rows the one that the fit
    ended with, and does its gradient stay within the variant's bound?
    """
    rows = _training_rows(spark, sf_dir)
    found = None
    for name, params in (("own", {}), ("defaults", sm.DEFAULT_PARAMS), ("settled", SETTLED)):
        model = sm.train(rows, **params)
        ended = F.lit(model.stages[-1].summary.objectiveHistory[-1])
        one = sm.optimality(model, rows).select(
            F.lit(name).alias("variant"),
            "n_rows",
            "n_features",
            (F.abs(F.col("objective") - ended) <= 1e-9).alias("objective_is_the_fits"),
            (F.col("largest_gradient") <= GRADIENT_BOUNDS[name]).alias("gradient_within_bound"),
        )
        found = one if found is None else found.unionByName(one)
    return found


def jobs_over_files(spark, sf_dir) -> DataFrame:
    """B2, B3, B4 with S2, K2, S4, K4, K5 against the same steps in memory.

    Review lines to features to a model to answers for all documents; documents, and those
    that get another probability or a wrong message.
    """
    lines, features, model = (shared_path(spark, p) for p in ("reviews", "features", "model"))
    sm.write_lines(_rated_lines(spark, sf_dir), lines)
    sm.run_features(spark, lines, features)
    sm.run_train(spark, features, model)
    reviews = _all_reviews(spark, sf_dir)
    in_memory = sm.train(sm.parse_training_lines(feature_lines(spark, sf_dir), line="line"))
    expected = _probabilities(in_memory, reviews, "p_expected")
    scored = sm.run_score(model, expected.join(reviews, "doc_id"))
    again = _probabilities(sm.load_model(model), reviews, "p")
    differs = (F.abs(F.col("p") - F.col("p_expected")) > 1e-6) | _message_is_wrong()
    return scored.join(again, "doc_id").agg(F.count("*").alias("n_documents"), F.count_if(differs).alias("n_different"))


def score_reviews(spark, sf_dir) -> DataFrame:
    """Every document scored, and is its message that of its prediction?"""
    model = sm.train(_training_rows(spark, sf_dir))
    scored = sm.score(model, _all_reviews(spark, sf_dir))
    return scored.select("doc_id", (~_message_is_wrong()).alias("message_is_right"))


def score_messages(spark, sf_dir) -> DataFrame:
    """P11 with the label in the place of the prediction, P10."""
    reviews = _rated(spark, sf_dir).select(
        "doc_id", F.col("text").alias("review"), F.col("quality").cast("double").alias("prediction")
    )
    return sm.with_defaults(reviews).select(
        "doc_id", "afterRelease", "version", "label", sm.sentiment_message().alias("message")
    )


def _stream_scored(spark, sf_dir, model) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders; the name of a single file is a pattern for itself alone.
    files = spark.read.parquet(path).inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith("/documents.parquet")
    escaped = "".join(f"[{c}]" if c in "*?[]{}" else c for c in path)
    source = f"{escaped[:-1]}[{escaped[-1]}]" if single else path
    stream = (
        spark.readStream.schema(schema).parquet(source).select("doc_id", F.col("text").alias("review"))
    )
    target = shared_path(spark, "scored")
    sm.score_stream(model, stream, target, shared_path(spark, "scored-checkpoint")).awaitTermination()
    return spark.read.parquet(target)


def stream_score(spark, sf_dir) -> DataFrame:
    """Every document scored, and is its message that of its prediction?"""
    model = sm.train(_training_rows(spark, sf_dir))
    return _stream_scored(spark, sf_dir, model).select("doc_id", (~_message_is_wrong()).alias("message_is_right"))


def stream_against_batch(spark, sf_dir) -> DataFrame:
    """R1 and B4 side by side: documents, and how many answers only one of the two gave.

    Answers are counted on both sides and the counts subtracted, which needs no
    join and stays small for repeated ids.
    """
    model = sm.train(_training_rows(spark, sf_dir))
    reviews = _documents(spark, sf_dir).withColumnRenamed("text", "review")
    batch = sm.score(model, reviews).select("doc_id", "message", F.lit(1).alias("in_batch"), F.lit(1).alias("sign"))
    streamed = _stream_scored(spark, sf_dir, model).select("doc_id", "message", F.lit(0), F.lit(-1))
    answers = (
        batch.union(streamed)
        .groupBy("doc_id", "message")
        .agg(F.sum("in_batch").alias("in_batch"), F.sum("sign").alias("surplus"))
    )
    return answers.agg(
        F.sum("in_batch").alias("n_documents"), F.sum(F.abs("surplus")).alias("n_different")
    )


def stream_features(spark, sf_dir) -> DataFrame:
    """B2, S3, J1 on a stream: review lines that arrive in two rounds, with a calendar read in each.

    The documents with an even number come in the first round, the others in the second.
    """
    lines, calendar, target, checkpoint = (
        shared_path(spark, p) for p in ("arriving-lines", "calendar", "streamed-features", "features-checkpoint")
    )
    sm.write_lines(sm.default_releases(spark).select(F.date_format("release", "M/d/yyyy")), calendar)
    rated = _rated(spark, sf_dir)
    rating = F.when(F.col("quality") == 1, F.col("doc_id") % 3 + 3).otherwise(F.col("doc_id") % 2 + 1)
    for remainder in (0, 1):
        arriving = rated.filter(F.pmod("doc_id", F.lit(2)) == remainder)
        sm.write_lines(_review_lines(arriving, rating, _one_line()), lines, mode="append")
        sm.run_features_stream(spark, lines, calendar, target, checkpoint)
    return spark.read.text(target).select(F.col("value").alias("line"))


def stream_score_rounds(spark, sf_dir) -> DataFrame:
    """A model published between two rounds; answers of each round, and those not of its model.

    The second round's documents, with an odd number, are to be answered by the second model, which
    is trained on the labels turned round.
    """
    rows, reviews = _training_rows(spark, sf_dir), _all_reviews(spark, sf_dir)
    models, arriving, target, checkpoint = (
        shared_path(spark, p) for p in ("model", "arriving-reviews", "scored-rounds", "rounds-checkpoint")
    )
    expected, found = [], None
    for remainder, name in ((0, "first"), (1, "second")):
        turned = F.col("label") if remainder == 0 else 1 - F.col("label")
        model = sm.train(rows.withColumn("label", turned))
        sm.save_model(model, models)
        reviews.filter(F.pmod("doc_id", F.lit(2)) == remainder).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(reviews.schema).parquet(arriving)
        expected.append((name, sm.run_score_round(spark, models, stream, target, checkpoint), model))
    scored = spark.read.parquet(target)
    for name, version, model in expected:
        again = sm.score(model, scored.select("doc_id", "review", "model_version", F.col("message").alias("given")))
        own = again.filter((F.pmod("doc_id", F.lit(2)) == (0 if name == "first" else 1)))
        wrong = (F.col("model_version") != version) | (F.col("message") != F.col("given"))
        one = own.agg(F.lit(name).alias("round"), F.count("*").alias("n_documents"), F.count_if(wrong).alias("n_wrong"))
        found = one if found is None else found.unionByName(one)
    return found


_QUERIES = [
    ingest_quoted_lines,
    ingested_files,
    legacy_features,
    parse_review_fields,
    blank_reviews_removed,
    review_dates,
    release_years,
    release_file,
    after_release_events,
    after_release_orders,
    after_release_shipments,
    rating_labels,
    sentiment_labels,
    build_features,
    feature_lines,
    written_feature_lines,
    written_features,
    header_csv,
    training_rows,
    training_file,
    object_lines_with_blanks,
    ingest_dropping_short_lines,
    features_dropping_bad_lines,
    training_dropping_bad_lines,
    rejected_records,
    token_counts,
    term_frequencies,
    term_doc_freq,
    term_tfidf,
    hashed_tf,
    idf_hashed,
    idf_hashed_wide,
    idf_of_merged_state,
    term_doc_freq_of_merged_state,
    train_and_score,
    train_default_variant,
    training_loss,
    fit_moments,
    fit_optimality,
    saved_model_against_unsaved,
    replaced_model,
    predictions_recomputed,
    jobs_over_files,
    score_reviews,
    score_messages,
    stream_score,
    stream_against_batch,
    stream_score_rounds,
    stream_features,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: train on the labelled documents, save, load, score and count the answers."""
    return train_and_score(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {q.__name__: q for q in _QUERIES}
    if llm_queries:
        found |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


# ------------------------------------------------------------------------- SQL


def _values(dates: list[date]) -> str:
    return ", ".join(f"(DATE '{d}')" for d in dates)


def _default_dates() -> list[date]:
    parts = [word.split("/") for word in DEFAULT_RELEASES.split()]
    return [date(int(y), int(m), int(d)) for m, d, y in parts]


def _flag(day: str) -> str:
    """Existence test against ``cal(release)``."""
    return (
        f"EXISTS (SELECT 1 FROM cal WHERE year(cal.release) = year({day}) "
        f"AND {day} BETWEEN cal.release AND cal.release + 7)"
    )


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


_CAL = f"cal(release) AS (VALUES {_values(_default_dates())})"

_LABELLED = (
    "labelled AS (SELECT d.doc_id, d.text, coalesce(l.quality, CAST(d.doc_id % 2 AS INTEGER)) AS quality "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)

_DATE = "strftime(DATE '2008-01-01' + CAST((doc_id * 37) % 3653 AS INTEGER), '%b %d %Y')"
_DATE_TEXT = f"lower(substr({_DATE}, 1, 1)) || substr({_DATE}, 2)"


def _review_line(rating: str, body: str) -> str:
    return (
        f"{_DATE_TEXT} || ',' || (doc_id % 5) || '.' || (doc_id % 3) || ',' || ({rating}) || ',' || "
        f"{body} || ' '"
    )


_BODY = "replace(text, chr(10), ' ')"


def _fields(table: str, rating: str, body: str = _BODY) -> str:
    """CTE ``fields``: the trimmed fields of review lines, blank bodies left out."""
    return f"""
lines AS (SELECT {_review_line(rating, body)} AS line FROM {table}),
fields AS (
  SELECT {_trim("split_part(line, ',', 1)")} AS "date", {_trim("split_part(line, ',', 2)")} AS version,
         {_trim("split_part(line, ',', 3)")} AS rating, {_trim("split_part(line, ',', 4)")} AS body
  FROM lines WHERE {_trim("split_part(line, ',', 4)")} <> '')"""


_RATED = _fields("labelled", "CASE WHEN quality = 1 THEN 3 + doc_id % 3 ELSE 1 + doc_id % 2 END")

_FEATURES = f"""{_CAL}, {_LABELLED}, {_RATED},
dated AS (SELECT *, CAST(strptime(upper(substr("date", 1, 1)) || substr("date", 2), '%b %d %Y') AS DATE) AS day
          FROM fields),
features AS (
  SELECT body AS text, {_flag("day")} AS "afterRelease", version,
         CASE WHEN CAST(rating AS INTEGER) >= 3 THEN 1 ELSE 0 END AS label
  FROM dated)"""

_FEATURE_LINE = """text || ',' || CASE WHEN "afterRelease" THEN 'true' ELSE 'false' END || ',' || version || ',' || label"""

_MINUTES = "(doc_id * 7919) % 5260320"
_QUOTED = f"""{_LABELLED},
stamped AS (
  SELECT *, TIMESTAMP '2008-01-01' + to_minutes(CAST({_MINUTES} AS BIGINT)) + to_seconds(doc_id % 60) AS stamp
  FROM labelled),
quoted AS (
  SELECT '"' || doc_id || '","' || strftime(stamp, '%-d/%-m/%Y %H:%M:%S') || '","' || {_BODY} || '","' ||
         CASE WHEN quality = 0 THEN 'Negative' WHEN doc_id % 2 = 0 THEN 'neutral' ELSE 'Positive' END ||
         '","user' || (doc_id % 97) || '"' AS line
  FROM stamped),
basic AS (
  SELECT split_part(line, '","', 3) AS text, split_part(line, '","', 2) AS "date",
         split_part(line, '","', 4) AS sentiment
  FROM quoted)"""

# Tokens: lower case, split on each whitespace, blank tokens at the end dropped.
def _tokens(table: str = "documents") -> str:
    return rf"""tokens AS (
  SELECT doc_id, CASE WHEN text = '' THEN [''] WHEN stripped = '' THEN []
                      ELSE string_split_regex(stripped, '[ \t\n\x0B\f\r]') END AS words
  FROM (SELECT doc_id, text, regexp_replace(lower(text), '[ \t\n\x0B\f\r]+$', '') AS stripped FROM {table})),
pairs AS (SELECT doc_id, unnest(words) AS term FROM tokens)"""


_TOKENS = _tokens()

_TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM pairs GROUP BY doc_id, term)"

# The 32-bit Murmur3 hash (seed 42) of each term's bytes, four at a time.
def _buckets(width: int, table: str = "documents") -> str:
    return f"""{_tokens(table)},
coded AS (SELECT term, hex(encode(term)) AS hx, octet_length(encode(term)) AS n
          FROM (SELECT DISTINCT term FROM pairs)),
mixed AS (
  SELECT term, hx, n, 0 AS i, CAST(42 AS UBIGINT) AS h FROM coded
  UNION ALL
  SELECT term, hx, n, i + 1, h3 FROM (
    SELECT term, hx, n, i,
           CAST('0x' || substr(hx, i * 8 + 7, 2) || substr(hx, i * 8 + 5, 2)
                     || substr(hx, i * 8 + 3, 2) || substr(hx, i * 8 + 1, 2) AS UBIGINT) AS w,
           (w * 3432918353) % 4294967296 AS k1,
           (k1 * 32768) % 4294967296 + k1 // 131072 AS k2,
           xor(h, (k2 * 461845907) % 4294967296) AS h1,
           (h1 * 8192) % 4294967296 + h1 // 524288 AS h2,
           (h2 * 5 + 3864292196) % 4294967296 AS h3
    FROM mixed WHERE i < n // 4)),
hashed AS (
  SELECT term,
         CASE n % 4 WHEN 0 THEN '0x0'
                    WHEN 1 THEN '0x' || substr(hx, n * 2 - 1, 2)
                    WHEN 2 THEN '0x' || substr(hx, n * 2 - 1, 2) || substr(hx, n * 2 - 3, 2)
                    ELSE '0x' || substr(hx, n * 2 - 1, 2) || substr(hx, n * 2 - 3, 2) || substr(hx, n * 2 - 5, 2)
         END AS tail,
         (CAST(tail AS UBIGINT) * 3432918353) % 4294967296 AS k1,
         (k1 * 32768) % 4294967296 + k1 // 131072 AS k2,
         xor(xor(h, (k2 * 461845907) % 4294967296), CAST(n AS UBIGINT)) AS h1,
         (xor(h1, h1 // 65536) * 2246822507) % 4294967296 AS h2,
         (xor(h2, h2 // 8192) * 3266489909) % 4294967296 AS h3,
         CAST(xor(h3, h3 // 65536) AS BIGINT) AS h4,
         CASE WHEN h4 >= 2147483648 THEN h4 - 4294967296 ELSE h4 END AS signed,
         CAST(((signed % {width}) + {width}) % {width} AS INTEGER) AS bucket
  FROM mixed WHERE i = n // 4),
cells AS (SELECT p.doc_id, h.bucket, CAST(count(*) AS DOUBLE) AS tf
          FROM pairs p JOIN hashed h ON p.term = h.term GROUP BY p.doc_id, h.bucket)"""


def _idf(n: str, df: str) -> str:
    return f"CASE WHEN {df} >= 10 THEN ln(({n} + 1.0) / ({df} + 1.0)) ELSE 0.0 END"


def _idf_of_buckets(width: int) -> str:
    return f"""
WITH RECURSIVE {_buckets(width)},
n AS (SELECT count(*) AS n FROM documents),
freq AS (SELECT b.bucket, count(c.doc_id) AS doc_freq
         FROM (SELECT CAST(range AS INTEGER) AS bucket FROM range({width})) b
         LEFT JOIN cells c ON b.bucket = c.bucket GROUP BY b.bucket)
SELECT bucket, CASE WHEN doc_freq >= 10 THEN doc_freq ELSE 0 END AS doc_freq,
       round({_idf("n", "doc_freq")}, 6) AS idf
FROM freq CROSS JOIN n"""


def _moments(width: int) -> str:
    """CTEs up to ``moments``: each feature's moments over the documents with a label."""
    return f"""
WITH RECURSIVE rated AS (
  SELECT d.doc_id, d.text, CAST(l.quality AS DOUBLE) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
{_buckets(width, "rated")},
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS share FROM rated),
weights AS (SELECT bucket, {_idf("any_value(n)", "count(*)")} AS idf FROM cells CROSS JOIN n GROUP BY bucket),
sums AS (
  SELECT bucket, sum(tf * idf) AS s, sum(tf * idf * tf * idf) AS ss, sum(tf * idf * y) AS xy
  FROM cells JOIN weights USING (bucket) JOIN rated USING (doc_id) WHERE idf > 0 GROUP BY bucket),
moments AS (
  SELECT bucket, s / n AS mean, sqrt((ss - s * s / n) / (n - 1)) AS std, xy / n AS label_moment FROM sums CROSS JOIN n)"""


def _rows_and_features(variant: str, width: int) -> str:
    return f"""{_moments(width)}
SELECT '{variant}' AS variant, CAST(n AS BIGINT) AS n_rows, (SELECT count(*) FROM moments WHERE std > 0) AS n_features,
       true AS objective_is_the_fits, true AS gradient_within_bound
FROM n"""


def oracle_sql() -> dict[str, str]:
    widths = {"own": 1000, "defaults": sm.DEFAULT_PARAMS["num_features"], "settled": 1000}
    every_rating = "doc_id % 5 + 1"
    blanks = f"CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(9) || ',' ELSE '' END || {_BODY}"
    feature_lines_sql = f"WITH {_FEATURES} SELECT {_FEATURE_LINE} AS line FROM features"
    ingest_sql = f"""
WITH {_QUOTED}
SELECT text || ',' || "date" || ',' || sentiment AS line FROM basic"""
    features_sql = f"WITH {_FEATURES} SELECT * FROM features"
    answers_sql = """
SELECT CAST(l.quality AS DOUBLE) AS label, count(*) AS n_reviews, CAST(0 AS BIGINT) AS n_wrong_messages
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""
    none_different_sql = "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_different FROM documents"
    training_sql = f"""
WITH {_FEATURES}, lines2 AS (SELECT {_FEATURE_LINE} AS line FROM features)
SELECT split_part(line, ',', 1) AS review, lower(split_part(line, ',', 2)) = 'true' AS "afterRelease",
       split_part(line, ',', 3) AS version, CAST(split_part(line, ',', 4) AS DOUBLE) AS label
FROM lines2"""
    more = {}
    if llm_queries:
        more = llm_queries.oracle_sql()
        more |= {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return more | {
        "ingest_quoted_lines": ingest_sql,
        "ingested_files": ingest_sql,
        "legacy_features": f"""
WITH {_CAL}, {_QUOTED},
dated AS (SELECT *, strptime("date", '%d/%m/%Y %H:%M:%S') AS stamp FROM basic)
SELECT text, {_flag("CAST(stamp AS DATE)")} AS "afterRelease", CAST(hour(stamp) AS VARCHAR) AS version,
       CASE WHEN lower(sentiment) IN ('neutral', 'positive') THEN 1 ELSE 0 END AS label
FROM dated""",
        "parse_review_fields": f"WITH {_fields('documents', every_rating)} SELECT * FROM fields",
        "blank_reviews_removed": f"WITH {_fields('documents', every_rating, blanks)} SELECT * FROM fields",
        "review_dates": f"""
WITH texts AS (SELECT doc_id, {_DATE_TEXT} AS date_text FROM documents)
SELECT doc_id, date_text,
       CAST(strptime(upper(substr(date_text, 1, 1)) || substr(date_text, 2), '%b %d %Y') AS DATE) AS review_date
FROM texts""",
        "release_years": """
SELECT CAST(year(release) AS INTEGER) AS year, count(*) AS n_releases,
       string_agg(CAST(release AS VARCHAR), ' ' ORDER BY release) AS releases
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS release FROM orders) GROUP BY 1""",
        "release_file": """
SELECT CAST(o_orderdate AS DATE) AS release, count(*) AS n_lines FROM orders GROUP BY 1""",
        "after_release_events": f"""
WITH cal(release) AS (VALUES {_values(MONTHLY_2024)}),
days AS (SELECT event_id, CAST(ts AS DATE) AS "date" FROM events)
SELECT event_id, "date", {_flag('days."date"')} AS "afterRelease" FROM days""",
        "after_release_orders": f"""
WITH cal(release) AS (VALUES {_values(QUARTERLY)}),
days AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "date" FROM orders)
SELECT o_orderkey, "date", {_flag('days."date"')} AS "afterRelease" FROM days""",
        "after_release_shipments": f"""
WITH cal AS (SELECT min(CAST(o_orderdate AS DATE)) AS release FROM orders
             WHERE year(CAST(o_orderdate AS DATE)) % 3 <> 0
             GROUP BY year(CAST(o_orderdate AS DATE)), quarter(CAST(o_orderdate AS DATE))),
days AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS "date" FROM lineitem)
SELECT l_orderkey, l_linenumber, "date", {_flag('days."date"')} AS "afterRelease" FROM days
WHERE year("date") IN (SELECT year(release) FROM cal)""",
        "rating_labels": """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) % 5 + 1 AS VARCHAR) AS rating,
       CASE WHEN CAST(l_quantity AS INTEGER) % 5 + 1 >= 3 THEN 1 ELSE 0 END AS label
FROM lineitem""",
        "sentiment_labels": """
SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END AS label,
       CAST(hour(ts) AS VARCHAR) AS version
FROM events""",
        "build_features": features_sql,
        "written_features": features_sql,
        "header_csv": f"""
WITH {_FEATURES} SELECT text, "afterRelease", CAST(version AS DOUBLE) AS version, label FROM features""",
        "feature_lines": feature_lines_sql,
        "written_feature_lines": feature_lines_sql,
        "training_rows": training_sql,
        "training_file": training_sql,
        "object_lines_with_blanks": """
WITH bodies AS (
  SELECT text || chr(10) || chr(10) || text || chr(13) || chr(10) || chr(10) || chr(10) || doc_id AS body FROM documents)
SELECT value, count(*) AS n FROM (SELECT unnest(string_split(body, chr(10))) AS value FROM bodies) GROUP BY value""",
        "ingest_dropping_short_lines": f"""
SELECT {_BODY} AS text, 'day' AS "date", 'neutral' AS sentiment FROM documents WHERE doc_id % 10 > 2""",
        "features_dropping_bad_lines": f"""
WITH {_CAL},
lines AS (SELECT doc_id, {_DATE_TEXT} || ',' || doc_id || ',' || (doc_id % 5 + 1) || ',' || {_BODY} || ' ' AS line
          FROM documents WHERE doc_id % 10 > 4),
rows AS (SELECT doc_id, CAST(strptime({_DATE}, '%b %d %Y') AS DATE) AS day, {_trim("split_part(line, ',', 4)")} AS text FROM lines)
SELECT text, {_flag("day")} AS "afterRelease", CAST(doc_id AS VARCHAR) AS version,
       CASE WHEN doc_id % 5 + 1 >= 3 THEN 1 ELSE 0 END AS label
FROM rows WHERE text <> ''""",
        "training_dropping_bad_lines": f"""
SELECT replace({_BODY}, ',', ';') AS review, true AS "afterRelease", CAST(doc_id AS VARCHAR) AS version,
       CAST(doc_id % 2 AS DOUBLE) AS label
FROM documents WHERE doc_id % 10 > 2""",
        "rejected_records": """
WITH spoiled(job, remainder, reason, text) AS (VALUES
  ('ingest', 0, 'line has fewer than 4 fields', '"1","2","3"'), ('ingest', 1, 'line has fewer than 4 fields', ''),
  ('ingest', 2, 'line has fewer than 4 fields', 'no separator'),
  ('features', 0, 'line has fewer than 4 fields', 'mar 14 2016,1,4'),
  ('features', 1, 'rating is not an integer', 'mar 14 2016,1,4.5,x'),
  ('features', 2, 'not a MMM dd yyyy date', '14 mar 2016,1,4,x'),
  ('features', 3, 'no releases known for the year of', 'mar 14 1999,1,4,x'),
  ('training', 0, 'line has fewer than 4 fields', 'text,true,1'),
  ('training', 1, 'label is not a number', 'text,true,1,one'), ('training', 2, 'line has fewer than 4 fields', ''))
SELECT job, reason, spoiled.text AS text, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY job, reason) AS BIGINT) AS n_reported
FROM spoiled JOIN documents ON doc_id % 10 = remainder GROUP BY job, reason, spoiled.text""",
        "token_counts": f"WITH {_TOKENS} SELECT doc_id, CAST(len(words) AS BIGINT) AS n_tokens FROM tokens",
        "term_frequencies": f"WITH {_TOKENS}, {_TF} SELECT doc_id, term, tf FROM tf",
        "term_doc_freq": f"""
WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM pairs GROUP BY term""",
        "term_tfidf": f"""
WITH {_TOKENS}, {_TF},
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
weighted AS (SELECT doc_id, tf.term, tf, df, {_idf("n", "df")} AS idf
             FROM tf JOIN dfs ON tf.term = dfs.term CROSS JOIN n)
SELECT doc_id, term, tf, df, round(idf, 6) AS idf, round(tf * idf, 6) AS tf_idf FROM weighted""",
        "hashed_tf": f"WITH RECURSIVE {_buckets(1000)} SELECT doc_id, bucket, tf FROM cells",
        "idf_hashed": _idf_of_buckets(1000),
        "idf_hashed_wide": _idf_of_buckets(sm.DEFAULT_PARAMS["num_features"]),
        "idf_of_merged_state": _idf_of_buckets(1000),
        "term_doc_freq_of_merged_state": f"""
WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM pairs GROUP BY term""",
        "stream_features": feature_lines_sql,
        "stream_score_rounds": """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS round, count(*) AS n_documents, CAST(0 AS BIGINT) AS n_wrong
FROM documents GROUP BY 1""",
        "score_messages": f"""
WITH {_LABELLED}
SELECT doc_id, false AS "afterRelease", '0' AS version, CAST(0 AS DOUBLE) AS label,
       'Sentiment is ' || CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS message
FROM labelled""",
        "train_and_score": answers_sql,
        "train_default_variant": answers_sql,
        "training_loss": """
SELECT variant, count(*) AS n_reviews, true AS better_than_share
FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('own'), ('defaults')) v(variant)
GROUP BY variant""",
        "fit_moments": f"""{_moments(1000)}
SELECT bucket, round(mean, 6) AS mean, round(std, 6) AS std, round(label_moment, 6) AS label_moment, true AS at_optimum
FROM moments UNION ALL SELECT -1, 1.0, 0.0, round(share, 6), true FROM n""",
        "fit_optimality": " UNION ALL ".join(f"SELECT * FROM ({_rows_and_features(v, w)})" for v, w in widths.items()),
        "saved_model_against_unsaved": none_different_sql,
        "replaced_model": """
SELECT loaded, count(*) AS n_documents, CAST(0 AS BIGINT) AS n_different
FROM documents, (VALUES ('first save'), ('second save'), ('first version')) v(loaded) GROUP BY loaded""",
        "predictions_recomputed": none_different_sql,
        "jobs_over_files": none_different_sql,
        "score_reviews": "SELECT doc_id, true AS message_is_right FROM documents",
        "stream_score": "SELECT doc_id, true AS message_is_right FROM documents",
        "stream_against_batch": none_different_sql,
    }
