"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows regardless of order."""

import datetime
import glob
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(row[n]) for n in names) for row in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())


def differences(spark, con, folder, name, queries, oracles):
    names, rows = spark_rows(queries[name](spark, folder))
    if name not in oracles:
        return len(rows), []
    sql_names, expected = sql_rows(con, oracles[name])
    if names != sql_names:
        return len(rows), [f"columns {names} != {sql_names}"]
    if rows == expected:
        return len(rows), []
    left, right = set(rows) - set(expected), set(expected) - set(rows)
    return len(rows), [f"{len(rows)} rows, expected {len(expected)}; only here {len(left)}, only there {len(right)}",
                       f"{names}", f"here  {sorted(left)[:2]}", f"there {sorted(right)[:2]}"]


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry

    folder = sys.argv[1]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = sys.argv[2:] or list(entry.queries())
    for name in wanted:
        begun = time.time()
        try:
            count, problems = differences(spark, con, folder, name, entry.queries(), entry.oracle_sql())
        except Exception as exc:
            count, problems = -1, [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        mark = "FAIL" if problems else "ok" if name in entry.oracle_sql() else "rows"
        print(f"{mark:5} {name:28} {count:8} rows {time.time() - begun:6.2f}s", flush=True)
        for p in problems:
            print("      ", p[:1500])
