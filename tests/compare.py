"""Compares every query with its SQL on the tables of a folder: python tests/compare.py FOLDER [NAME...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{folder}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def differences(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    res = con.sql(sql)
    if sorted(res.columns) != cols:
        return f"columns {cols} and {sorted(res.columns)}"
    order = [res.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[k]) for k in order) for r in res.fetchall())
    if got == want:
        return ""
    return f"{len(got)} and {len(want)} rows; only here {[x for x in got if x not in set(want)][:3]}, only in SQL {[x for x in want if x not in set(got)][:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, sql = database(folder), entry.oracle_sql()
    for name, q in entry.queries().items():
        if name in sql and (not names or name in names):
            t = time.time()
            try:
                said = differences(spark, con, folder, name, q, sql[name])
            except Exception as e:
                said = f"{type(e).__name__}: {e}"
            print(f"{name}: {said[:600] or 'equal'} ({time.time() - t:.1f} s)", flush=True)
