"""Every registered query against its SQL, and the contract of the entry file."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {q.__name__: q for q in entry._QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, db, name):
    assert compare(QUERIES[name](spark, SF_DIR), db, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_flagship(spark):
    counts = entry.entry(spark)
    assert counts.columns == ["label", "n_reviews", "n_wrong_messages"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert counts.agg({"n_reviews": "sum"}).first()[0] == labels.count()


def test_a_joined_text_is_shuffled_once_at_most(spark):
    """Also without a broadcast, as with large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["ingest_quoted_lines"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "RoundRobinPartitioning" not in plan
    assert plan.count("Exchange hashpartitioning(doc_id") == 2  # one for each side of the join


def test_no_python_in_the_plans(spark):
    for name in ("build_features", "legacy_features", "training_rows", "term_frequencies", "hashed_tf"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "InPandas" not in plan, name


def test_a_replaced_model_is_asked_in_one_scan(spark, monkeypatch):
    """All five models answer a document where it is read, and another version's answers are found."""
    load = entry.sm.load_model
    monkeypatch.setattr(entry.sm, "load_model", lambda path, version=None: load(path))
    found = QUERIES["replaced_model"](spark, SF_DIR)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    different = {r["loaded"]: r["n_different"] for r in found.collect()}
    assert different["first save"] == different["second save"] == 0 < different["first version"]
