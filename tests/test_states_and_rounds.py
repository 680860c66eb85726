"""States of document frequencies, rounds of the streams, and the CSV source's one scan."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

import sentimill as sm
from sentimill import schemas

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")


def rows(df):
    return sorted(map(tuple, df.collect()))


# ----------------------------------------------------------------------- states


def parts(docs, n=3):
    return [docs.filter(F.pmod("doc_id", F.lit(n)) == i) for i in range(n)]


def test_merged_states_equal_one_pass(docs):
    of_terms = sm.merged_state(*[sm.term_state(p) for p in parts(docs)])
    assert rows(sm.term_frequencies_of(of_terms)) == rows(sm.document_frequencies(docs))
    of_buckets = sm.merged_state(*[sm.bucket_state(p) for p in parts(docs)])
    assert rows(sm.idf_of(of_buckets)) == rows(sm.hashed_idf(docs))
    wide = sm.idf_of(sm.bucket_state(docs, num_features=5000), num_features=5000, min_doc_freq=3)
    assert rows(wide) == rows(sm.hashed_idf(docs, num_features=5000, min_doc_freq=3))


def test_a_batch_that_is_written_again_replaces_itself(spark, docs, tmp_path):
    path, (first, second, _) = str(tmp_path / "states"), parts(docs)
    sm.add_to_state(sm.term_state(first), path, "1")
    sm.add_to_state(sm.term_state(docs), path, "2")
    sm.add_to_state(sm.term_state(second), path, "2")
    both = rows(sm.document_frequencies(first.unionByName(second)))
    assert rows(sm.term_frequencies_of(sm.read_state(spark, path))) == both
    assert sorted(os.listdir(path)) == ["batch=1", "batch=2"]
    compacted = str(tmp_path / "compacted")
    sm.compact_state(spark, path, compacted)
    assert os.listdir(compacted) == ["batch=compacted"]
    assert rows(sm.term_frequencies_of(sm.read_state(spark, compacted))) == both
    with pytest.raises(FileExistsError):
        sm.compact_state(spark, path, compacted)
    for name in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            sm.add_to_state(sm.term_state(first), path, name)


def test_reading_idf_from_a_state_reads_no_text(spark, docs, tmp_path):
    path = str(tmp_path / "states")
    sm.add_to_state(sm.bucket_state(docs), path, "all")
    plan = sm.idf_of(sm.read_state(spark, path))._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan


def test_states_of_odd_documents(spark):
    odd = spark.createDataFrame([(1, ""), (2, "  "), (3, "a a A b"), (3, "a")], "doc_id long, text string")
    assert dict(sm.term_state(odd).collect()) == {None: 4, "": 1, "a": 2, "b": 1}
    empty = sm.bucket_state(odd.limit(0))
    assert rows(empty) == [(None, 0)] and sm.idf_of(empty).filter("idf != 0 or doc_freq != 0").count() == 0
    assert rows(sm.merged_state(sm.term_state(odd), sm.term_state(odd.limit(0))).filter("key = 'a'")) == [("a", 2)]


# ----------------------------------------------------------------------- rounds


@pytest.fixture(scope="module")
def models(spark):
    """A model, and one trained on the labels turned round."""
    given = [("good", 1.0)] * 12 + [("bad", 0.0)] * 12
    train = lambda r: sm.train(spark.createDataFrame(r, "review string, label double"))
    return train(given), train([(text, 1 - label) for text, label in given])


def test_a_round_uses_the_model_that_is_current(spark, models, tmp_path):
    model, source, target, checkpoint = (str(tmp_path / n) for n in ("model", "source", "target", "checkpoint"))
    os.mkdir(source)
    stream = lambda: spark.readStream.schema("id long, review string").parquet(source)
    with pytest.raises(ValueError, match="no model"):
        sm.run_score_round(spark, model, stream(), target, checkpoint)
    versions = []
    for i, fitted in enumerate(models):
        sm.save_model(fitted, model)
        spark.createDataFrame([(i, "good")], "id long, review string").write.mode("append").parquet(source)
        versions.append(sm.run_score_round(spark, model, stream(), target, checkpoint))
    assert len(set(versions)) == 2
    scored = spark.read.parquet(target).select("id", "prediction", "model_version")
    assert rows(scored) == [(0, 1.0, versions[0]), (1, 0.0, versions[1])]
    sm.run_score_round(spark, model, stream(), target, checkpoint)  # nothing has come
    assert spark.read.parquet(target).count() == 2


def test_a_batch_that_runs_again_adds_nothing(spark, models, tmp_path):
    """A stop between the files of a batch and its entry in the checkpoint."""
    model, source, target, checkpoint = (str(tmp_path / n) for n in ("model", "source", "target", "checkpoint"))
    sm.save_model(models[0], model)
    for i in range(2):
        spark.createDataFrame([(i, "good")], "id long, review string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, review string").parquet(source)
        sm.run_score_round(spark, model, stream, target, checkpoint)
    commits = os.path.join(checkpoint, "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        shutil.move(os.path.join(commits, name), str(tmp_path / name.strip(".")))
    sm.save_model(models[1], model)
    stream = spark.readStream.schema("id long, review string").parquet(source)
    sm.run_score_round(spark, model, stream, target, checkpoint)
    assert os.path.exists(os.path.join(commits, str(last)))  # the batch ran again
    assert rows(spark.read.parquet(target).select("id", "prediction")) == [(0, 1.0), (1, 1.0)]


def test_streamed_features_equal_the_batch(spark, tmp_path):
    source, calendar, target, checkpoint = (str(tmp_path / n) for n in ("source", "calendar", "target", "checkpoint"))
    os.mkdir(source)
    first = ["mar 14 2016,1,4,good", "", "Nov 30 2016,2,1,bad, x", "mar 15 2016,1,4, "]
    second = ["may 05 2016,1,2,new", ""]
    (tmp_path / "calendar").write_text("3/13/2016\n")
    (tmp_path / "source" / "1.csv").write_text("\n".join(first))
    sm.run_features_stream(spark, source, calendar, target, checkpoint)
    got = lambda: sorted(r[0] for r in spark.read.text(target).collect())
    assert got() == ["bad,false,2,0", "good,true,1,1"]
    # A date added to the calendar counts from the next round on.
    (tmp_path / "calendar").write_text("3/13/2016\n5/1/2016\n")
    (tmp_path / "source" / "2.csv").write_text("\n".join(second))
    sm.run_features_stream(spark, source, calendar, target, checkpoint)
    assert got() == ["bad,false,2,0", "good,true,1,1", "new,true,1,0"]
    (tmp_path / "source" / "3.csv").write_text("short line")
    with pytest.raises(Exception, match="fewer than 4 fields"):
        sm.run_features_stream(spark, source, calendar, target, checkpoint)
    sm.run_features_stream(spark, source, calendar, target, checkpoint, on_error="drop")
    assert len(got()) == 3


# -------------------------------------------------------------------------- CSV


def write_csv(folder, *files):
    folder.mkdir()
    for i, lines in enumerate(files):
        (folder / f"{i}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_types_of_a_sample_hold_for_all_lines(spark, tmp_path):
    head = "review,afterRelease,version,label"
    path = write_csv(tmp_path / "in", [head, "a,true,1.5,1", '"b, c",false,2,0'], [head, "d,,3.25,", "e,true,1e3,7"])
    found = sm.read_header_csv(spark, path)
    assert found.dtypes == [("review", "string"), ("afterRelease", "boolean"), ("version", "double"), ("label", "int")]
    assert rows(found.select("review", "version", "label").fillna(-1)) == [("a", 1.5, 1), ("b, c", 2.0, 0), ("d", 3.25, -1), ("e", 1000.0, 7)]
    assert found.count() == 4 and found.select("label").count() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1


@pytest.mark.parametrize("late", ["x,true,1.5,4.5", "x,perhaps,1.5,1", "x,true,1.5,99999999999", "x,true,1.5,1,more", "x,true"])
def test_a_late_value_that_does_not_fit(spark, tmp_path, late):
    head = "review,afterRelease,version,label"
    path = write_csv(tmp_path / "in", [head, "a,true,1.5,1"], [head, "b,true,1.5,1", late])
    found = sm.read_header_csv(spark, path, sample_lines=2)
    for action in (found.count, found.select("review").collect):
        with pytest.raises(Exception, match="doesn't fit"):
            action()
    left = sm.read_header_csv(spark, path, sample_lines=2, on_error="drop")
    assert rows(left.select("review")) == [("a",), ("b",)]
    given = sm.read_header_csv(spark, path, schemas.TRAINING)
    assert given.columns == ["review", "afterRelease", "version", "label"]


def test_csv_without_rows(spark, tmp_path):
    path = write_csv(tmp_path / "in", ["review,label"])
    found = sm.read_header_csv(spark, path)
    assert found.columns == ["review", "label"] and found.count() == 0
