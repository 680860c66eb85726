"""Models and folders that readers see whole or not at all."""

import os

import pytest
from pyspark.ml.util import MLWriter

import sentimill as sm
from sentimill.sources import publish


@pytest.fixture(scope="module")
def models(spark):
    """Two models that answer the same review differently."""
    rows = [("good", 1.0)] * 12 + [("bad", 0.0)] * 12
    train = lambda r: sm.train(spark.createDataFrame(r, "review string, label double"))
    return train(rows), train([(text, 1 - label) for text, label in rows])


def answer(spark, path):
    return sm.run_score(path, spark.createDataFrame([("good",)], "review string")).first()["prediction"]


def test_a_second_save_replaces_the_first(spark, models, tmp_path):
    path = str(tmp_path / "model")
    first = sm.save_model(models[0], path)
    assert answer(spark, path) == 1.0 and sm.model_version(path) == first
    second = sm.save_model(models[1], path)
    assert answer(spark, path) == 0.0 and sm.model_version(path) == second != first
    assert sm.load_model(path, first).stages[3].intercept == models[0].stages[3].intercept


@pytest.mark.parametrize("stage", ["model", "pointer", "rename"])
def test_a_save_that_stops_half_way_leaves_the_former_model(spark, models, tmp_path, monkeypatch, stage):
    path = str(tmp_path / "model")
    former = sm.save_model(models[0], path)

    def stop(*args, **kwargs):
        raise RuntimeError("stopped")

    if stage == "model":
        # Some stages are written, the last one isn't.
        monkeypatch.setattr(type(models[1].stages[3].write()), "save", stop, raising=False)
        monkeypatch.setattr(MLWriter, "save", stop)
    monkeypatch.setattr(publish, {"pointer": "write_small", "rename": "replace_file"}.get(stage, "POINTER_UNUSED"), stop, raising=False)
    with pytest.raises(Exception, match="stopped"):
        sm.save_model(models[1], path)
    monkeypatch.undo()
    assert sm.model_version(path) == former and answer(spark, path) == 1.0
    sm.save_model(models[1], path)
    assert answer(spark, path) == 0.0


def test_former_versions_go_but_the_latest(spark, models, tmp_path):
    path = str(tmp_path / "model")
    versions = [sm.save_model(models[i % 2], path, keep=2) for i in range(5)]
    left = {n for n in os.listdir(path) if n.startswith("version-")}
    assert left == set(versions[2:]) and sm.model_version(path) == versions[4]
    assert not [n for n in os.listdir(path) if n.startswith("_CURRENT")]


def test_a_plain_model_folder_is_loaded(spark, models, tmp_path):
    path = str(tmp_path / "plain")
    models[0].write().save(path)
    assert sm.model_version(path) is None and answer(spark, path) == 1.0
    sm.save_model(models[1], path)  # from now on versions count
    assert answer(spark, path) == 0.0
    with pytest.raises(Exception):
        sm.load_model(str(tmp_path / "nothing"))


def test_folders_are_published_whole(spark, tmp_path):
    target, texts = str(tmp_path / "out"), lambda: sorted(r[0] for r in spark.read.text(target).collect())

    def staged(*values):
        path = publish.beside(target, "test")
        spark.createDataFrame([(v,) for v in values], "value string").write.text(path)
        return path

    publish.publish_folder(spark, staged("a"), target, "errorifexists")
    assert texts() == ["a"]
    publish.publish_folder(spark, staged("b", "c"), target, "append")
    assert texts() == ["a", "b", "c"]
    publish.publish_folder(spark, staged("d"), target, "overwrite")
    assert texts() == ["d"] and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        publish.rename(spark, staged("e"), target)
    assert texts() == ["d"]
