"""Run registered queries beside their SQL twins: python tests/check_oracle.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "date": "DATE", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(con, spark, sf_dir, name, query, sql):
    """None when both sides hold exactly the same rows, else a description."""
    df = query(spark, sf_dir)
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    duck_cols, duck_rows = rows_of([d[0] for d in result.description], result.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} != {duck_cols}"
    spark_types = sorted((c, TYPES.get(t, t)) for c, t in df.dtypes)
    duck_types = sorted((d[0], str(d[1])) for d in result.description)
    if spark_types != duck_types:
        return f"types {set(spark_types) ^ set(duck_types)}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows != {len(duck_rows)}"
    for s, d in zip(spark_rows, duck_rows):
        if s != d:
            return f"{s}\n      != {d}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = duck(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(con, spark, sf_dir, name, query, oracle[name])
                note = "same"
            else:
                problem, note = None, f"rows only: {query(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
