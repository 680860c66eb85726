from collections import Counter

import pytest
from pyspark.sql import functions as F

import sentimill as sm
from sentimill import schemas
from sentimill.session import shared_path


def values(df):
    return sorted(r[0] for r in df.collect())


def test_read_lines_knows_all_line_endings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\n\nthree")
    assert values(sm.read_lines(spark, str(tmp_path))) == ["", "one", "three", "two"]


def object_lines(content):
    """The rule said another way: split on newline, drop empty lines at the end."""
    parts = content.split("\n")
    while parts and parts[-1] == "":
        parts.pop()
    return parts


CONTENTS = [
    "a\nb", "a\nb\n", "a\n\n\n", "a\r\n\r\n", "\n\na\n\n\nb\n\n", "\n\n\n", "é\n \n\nü\n", "x",
]


@pytest.mark.parametrize("split_bytes", ["128m", "5"])
def test_object_lines(spark, tmp_path, split_bytes):
    for i, content in enumerate(CONTENTS):
        (tmp_path / f"{i}.txt").write_bytes(content.encode())
    want = sorted(line for content in CONTENTS for line in object_lines(content))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = str(tmp_path)
        assert values(sm.read_object_lines(spark, path)) == want
        assert values(sm.read_object_lines(spark, path, "skip")) == [w for w in want if w]
        everything = sorted(
            line for c in CONTENTS for line in (c[:-1] if c[-1] == "\n" else c).split("\n")
        )
        assert values(sm.read_object_lines(spark, path, "keep")) == everything
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(ValueError):
        sm.read_object_lines(spark, path, "some")


def test_many_inner_blank_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a" + "\n" * 25_001 + "b" + "\n" * 12_345)
    lines = sm.read_object_lines(spark, str(tmp_path))
    assert lines.filter("value = ''").count() == 25_000
    assert lines.count() == 25_002


def test_line_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    text = ['plain, "quoted" \\ text', "carriage\r", "  spaces  ", "ünï"]
    sm.write_lines(spark.createDataFrame([(t,) for t in text], "line string"), path)
    assert values(sm.read_object_lines(spark, path)) == sorted(text)
    with pytest.raises(Exception, match="already exists"):
        sm.write_lines(spark.range(1).select(F.lit("x")), path)
    sm.write_lines(spark.range(1).select(F.lit("x")), path, mode="overwrite")
    assert values(sm.read_lines(spark, path)) == ["x"]


def test_write_lines_does_not_gather_the_data(spark, tmp_path):
    path = tmp_path / "out"
    sm.write_lines(spark.range(0, 100, 1, 5).select(F.col("id").cast("string")), str(path))
    assert len(list(path.glob("part-*"))) == 5


def test_training_rows(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("good,true,1,1\nbad,false,2,0\n\n")
    rows = sm.read_training_rows(spark, str(tmp_path / "rows.csv"))
    assert [(f.name, f.dataType) for f in rows.schema] == [
        (f.name, f.dataType) for f in schemas.TRAINING
    ]
    assert sorted(map(tuple, rows.collect())) == [
        ("bad", False, "2", 0.0),
        ("good", True, "1", 1.0),
    ]


def test_header_csv(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("review,afterRelease,version,label\ngüt,true,1.5,1\n")
    inferred = sm.read_header_csv(spark, str(tmp_path / "rows.csv"))
    assert inferred.dtypes == [
        ("review", "string"),
        ("afterRelease", "boolean"),
        ("version", "double"),
        ("label", "int"),
    ]
    given = sm.read_header_csv(spark, str(tmp_path / "rows.csv"), schemas.TRAINING)
    assert tuple(given.first()) == ("güt", True, "1.5", 1.0)


def test_record_round_trip(spark, tmp_path):
    rows = [("a, b\nc", True, "1", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, schemas.FEATURES)
    sm.write_records(df, str(tmp_path / "out"))
    back = sm.read_records(spark, str(tmp_path / "out"), schemas.FEATURES)
    assert set(map(tuple, back.collect())) == set(rows) and back.schema == schemas.FEATURES


def test_shared_path_follows_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_path(spark, "thing")
    assert path != shared_path(spark, "thing")
    if before:
        assert path.startswith(before)


def test_spread_only_shuffles_few_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    assert sm.spread(spark.range(0, 10, 1, cores)).rdd.getNumPartitions() == cores
    many = spark.range(0, 10, 1, 2 * cores)
    assert sm.spread(many) is many


def test_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    """Neither tasks nor staged files grow with the number of splits."""
    import __spark_entry__ as entry

    texts = {i: "\n".join(f"{i} {i % 7} {k} " + "x" * 200 for k in range(25)) for i in range(1_000)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr("sentimill.sources.lines.shared_path", lambda spark, purpose: str(tmp_path / purpose))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.maxPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    got = {r["value"]: r["n"] for r in entry.object_lines_with_blanks(spark, str(tmp_path)).collect()}
    bodies = [f"{text}\n\n{text}\r\n\n\n{i}" for i, text in texts.items()]
    assert got == Counter(line for body in bodies for line in body.split("\n"))
    # 10 MB in splits of 64 KB are 160.
    assert len(list((tmp_path / "object-lines").glob("part-*"))) <= 8 * spark.sparkContext.defaultParallelism
    assert [spark.conf.get(n, None) for n in names] == before
