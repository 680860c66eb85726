"""Jobs that read their input once, publish all or nothing, and tell what they have left out."""

import os
import random

import pytest
from pyspark.sql import functions as F

import sentimill as sm
from sentimill.sources.lines import SPLIT, held_blank_lines, scan_object_lines, split_states

GOOD, BAD = "mar 14 2016,1,4,good", "Nov 30 2016,2,1,bad"
TRAINING = "\n".join(f"{'good' if i % 2 else 'bad'} text,true,1,{i % 2}" for i in range(40))


@pytest.fixture
def small_splits(spark):
    """File splits of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "7", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def texts(spark, path):
    return sorted(r[0] for r in spark.read.text(path).collect())


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan text")


# ------------------------------------------------------------------------ lines


def expected(content):
    """All lines up to the last one with text."""
    parts = content.split("\n")
    while parts and not parts[-1]:
        parts.pop()
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_one_scan_finds_the_inner_blank_lines(spark, tmp_path, small_splits, seed):
    """Files of runs of blank lines longer and shorter than a split, several files to a task."""
    rng = random.Random(seed)
    want = []
    for i in range(5):
        pieces = [rng.choice(["a", "bc", "\r", "a line of text"]) + "\n" * rng.choice([1, 1, 2, 9, 30]) for _ in range(rng.randint(0, 6))]
        content = "\n" * rng.choice([0, 1, 20]) + "".join(pieces)
        (tmp_path / f"{i}.txt").write_bytes(content.encode())
        want += expected(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", rng.choice(["7", "16", "1m"]))
    scanned = scan_object_lines(spark, str(tmp_path))
    assert scans(scanned) == 1
    kept = scanned.filter("_rejected IS NULL").select("value").unionByName(held_blank_lines(split_states(scanned)))
    assert sorted(r[0] for r in kept.collect()) == sorted(want)
    staged = sm.read_object_lines(spark, str(tmp_path))
    assert sorted(r[0] for r in staged.collect()) == sorted(want)
    assert str(tmp_path) not in "".join(staged.inputFiles())  # read again from what the one scan has written


def test_the_state_of_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("ab\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\ncd\n\n")
    scanned = scan_object_lines(spark, str(tmp_path))
    states = split_states(scanned).orderBy("start").collect()
    assert states[0]["text"] and sum(r["text"] for r in states) == 2 and len({r["file"] for r in states}) == 1
    n_lines = scanned.filter("_rejected IS NULL").count()
    assert n_lines + sum(r["blanks"] for r in states) == 20 and scanned.filter(F.col("_rejected") == SPLIT).count() == len(states) > 3


def test_workers_need_not_have_the_package(spark, tmp_path):
    """The function that tasks run is sent whole."""
    from pyspark import cloudpickle

    from sentimill.sources import lines

    assert len(cloudpickle.dumps(lines._held_back)) > 1_000  # by name it would be its name
    (tmp_path / "a.txt").write_text("x\n\n")
    assert scan_object_lines(spark, str(tmp_path)).count() == 2


# ------------------------------------------------------------------- feature job


@pytest.mark.parametrize("blanks", [1, 40])
def test_blank_lines_inside_a_file_end_the_job(spark, tmp_path, small_splits, blanks):
    """Also when they fill whole splits; nothing is published, and nothing stays beside the target."""
    path = tmp_path / "in" / "reviews.csv"
    path.parent.mkdir()
    path.write_text(GOOD + "\n" * (1 + blanks) + BAD + "\n" * 30)
    target = str(tmp_path / "out")
    with pytest.raises(Exception, match="fewer than 4 fields"):
        sm.run_features(spark, str(path), target)
    assert os.listdir(tmp_path) == ["in"]
    report = {}
    sm.run_features(spark, str(path), target, on_error="drop", report=report, quarantine=str(tmp_path / "bad"))
    assert texts(spark, target) == ["bad,false,2,0", "good,true,1,1"]
    assert report == {"rejected": blanks, "line has fewer than 4 fields": blanks}
    bad = sm.rejected_lines(spark, str(tmp_path / "bad")).collect()
    assert [tuple(r) for r in bad] == [("line has fewer than 4 fields", "")] * blanks
    assert sorted(os.listdir(tmp_path)) == ["bad", "in", "out"]


def test_blank_lines_at_the_end_are_none(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    for i, text in enumerate((GOOD + "\n" * 50, "\n" * 20, BAD, "")):
        (tmp_path / "in" / f"{i}.csv").write_text(text)
    report = {}
    sm.run_features(spark, str(tmp_path / "in"), str(tmp_path / "out"), report=report)
    assert texts(spark, str(tmp_path / "out")) == ["bad,false,2,0", "good,true,1,1"] and report == {"rejected": 0}
    assert "_SUCCESS" in os.listdir(tmp_path / "out")


def test_the_feature_job_reads_its_input_once(spark, tmp_path, monkeypatch):
    """The written frame scans the input once; what is read after that is beside the target."""
    from sentimill.plans import outcome

    (tmp_path / "reviews.csv").write_text(GOOD + "\n\n" + BAD + "\n\n")
    seen, write = [], outcome._write

    def watched(marked, *args):
        seen.append(scans(marked))
        write(marked, *args)

    monkeypatch.setattr(outcome, "_write", watched)
    sm.run_features(spark, str(tmp_path / "reviews.csv"), str(tmp_path / "out"), on_error="drop")
    assert seen == [1]


def test_every_rule_is_counted(spark, tmp_path):
    lines = [GOOD, "short", "mar 14 2016,1,x,good", "14 mar 2016,1,4,good", "mar 14 1999,1,4,good", "mar 14 2016,1,4, ", "short, too"]
    (tmp_path / "reviews.csv").write_text("\n".join(lines) + "\n")
    report, bad = {}, str(tmp_path / "bad")
    sm.run_features(spark, str(tmp_path / "reviews.csv"), str(tmp_path / "out"), on_error="drop", quarantine=bad, report=report)
    assert texts(spark, str(tmp_path / "out")) == ["good,true,1,1"]
    by_rule = {
        "line has fewer than 4 fields": ["short", "short, too"],
        "rating is not an integer": ["mar 14 2016,1,x,good"],
        "not a MMM dd yyyy date": ["14 mar 2016,1,4,good"],
        "no releases known for the year of": ["mar 14 1999,1,4,good"],
    }
    assert report == {"rejected": 5} | {rule: len(found) for rule, found in by_rule.items()}
    assert {tuple(r) for r in sm.rejected_lines(spark, bad).collect()} == {(k, t) for k, v in by_rule.items() for t in v}


@pytest.mark.parametrize("mode", ["errorifexists", "append", "overwrite", "ignore"])
def test_modes(spark, tmp_path, mode):
    source, target = tmp_path / "reviews.csv", str(tmp_path / "out")
    source.write_text(GOOD)
    sm.run_features(spark, str(source), target)
    source.write_text(BAD)
    if mode == "errorifexists":
        with pytest.raises(FileExistsError, match="already exists"):
            sm.run_features(spark, str(source), target, mode=mode)
    else:
        sm.run_features(spark, str(source), target, mode=mode)
    good, bad = "good,true,1,1", "bad,false,2,0"
    assert texts(spark, target) == {"append": [bad, good], "overwrite": [bad]}.get(mode, [good])
    with pytest.raises(ValueError, match="mode"):
        sm.run_features(spark, str(source), target, mode="other")
    assert sorted(os.listdir(tmp_path)) == ["out", "reviews.csv"]


def test_a_failed_overwrite_leaves_the_former_output(spark, tmp_path):
    source, target = tmp_path / "reviews.csv", str(tmp_path / "out")
    source.write_text(GOOD)
    sm.run_features(spark, str(source), target)
    source.write_text("broken")
    with pytest.raises(Exception, match="fewer than 4 fields: broken"):
        sm.run_features(spark, str(source), target, mode="overwrite")
    assert texts(spark, target) == ["good,true,1,1"]


def test_an_empty_input_gives_an_empty_output(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("")
    sm.run_features(spark, str(tmp_path / "in"), str(tmp_path / "out"), quarantine=str(tmp_path / "bad"))
    sm.run_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out2"), quarantine=str(tmp_path / "bad2"), on_error="drop")
    assert all(texts(spark, str(tmp_path / n)) == [] for n in ("out", "bad", "out2", "bad2"))


# ----------------------------------------------------------- ingest and training


def test_ingest_tells_what_it_leaves_out(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('"1","25/8/2016 08:49:14","fine, thanks","Positive","u"\n\nbroken "line"\n')
    report, bad = {}, str(tmp_path / "bad")
    with pytest.raises(Exception, match="fewer than 4 fields"):
        sm.run_ingest(spark, str(tmp_path / "raw.csv"), str(tmp_path / "out"))
    sm.run_ingest(spark, str(tmp_path / "raw.csv"), str(tmp_path / "out"), on_error="drop", quarantine=bad, report=report)
    assert texts(spark, str(tmp_path / "out")) == ["fine, thanks,25/8/2016 08:49:14,Positive"]
    assert report["rejected"] == 2 and {r["text"] for r in sm.rejected_lines(spark, bad).collect()} == {"", 'broken "line"'}


def test_training_checks_its_lines_before_the_fit(spark, tmp_path, small_splits):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    source, model = tmp_path / "rows.csv", str(tmp_path / "model")
    for spoiled, complaint in (("a,true,1", "fewer than 4 fields: a,true,1"), ("a,true,1,x", "label is not a number"), ("\n" * 300, "fewer than 4")):
        source.write_text(TRAINING + "\n" + spoiled + "\n" + TRAINING + "\n\n\n")
        with pytest.raises(Exception, match=complaint):
            sm.run_train(spark, str(source), model)
        assert not os.path.exists(model)
    report, bad = {}, str(tmp_path / "bad")
    fitted = sm.run_train(spark, str(source), model, on_error="drop", report=report, quarantine=bad)
    assert report == {"rejected": 301, "line has fewer than 4 fields": 301}
    assert sm.rejected_lines(spark, bad).count() == 301
    source.write_text(TRAINING + "\n" + TRAINING + "\n" + "\n" * 300)
    plain = sm.run_train(spark, str(source), model)
    assert plain.stages[3].coefficients.toArray() == pytest.approx(fitted.stages[3].coefficients.toArray())
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_marked_records(spark, lines):
    marked = sm.build_features(lines(GOOD, "broken", BAD), sm.default_releases(spark), on_error="mark")
    assert sorted(r["text"] for r in sm.accepted(marked).collect()) == ["bad", "good"]
    assert sm.accepted(marked).columns == ["text", "afterRelease", "version", "label"]
    assert [tuple(r) for r in sm.rejected(marked).collect()] == [("line has fewer than 4 fields", "broken")]
    assert dict(sm.rejections(marked).collect()) == {"line has fewer than 4 fields": 1}
    with pytest.raises(ValueError, match="on_error"):
        sm.run_features(spark, "x", "y", on_error="mark")
