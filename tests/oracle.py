"""Run the registered queries and compare them with their SQL in DuckDB.

    python tests/oracle.py [sf_dir] [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def compare(spark_df, db, sql):
    """None when equal, otherwise what differs. Rows are compared as a multiset."""
    got = spark_df.toArrow()
    want = db.sql(sql).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {got.column_names} against {want.column_names}"
    types = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    odd = [t for t in types if t[1] != t[2]]
    if odd:
        return f"types {odd}"
    if got.num_rows != want.num_rows:
        return f"{got.num_rows} rows against {want.num_rows}"
    mem = duckdb.connect()
    mem.register("got", got)
    mem.register("want", want)
    columns = ", ".join(f'"{n}"' for n in names)
    extra = mem.execute(
        f"SELECT {columns} FROM got EXCEPT ALL SELECT {columns} FROM want LIMIT 3"
    ).fetchall()
    return f"rows such as {extra}" if extra else None


def main():
    import __spark_entry__ as entry
    from sentimill.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, db, sql = local_session(8), connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        df = query(spark, sf_dir)
        if name in sql:
            problem = compare(df, db, sql[name])
            state = "equal" if problem is None else f"DIFFERENT: {problem}"
            bad += problem is not None
        else:
            state = f"{df.count()} rows, no SQL"
        print(f"{name:26} {time.time() - start:6.2f}s  {state}", flush=True)
    spark.stop()
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
