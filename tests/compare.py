"""Run named queries next to their oracle SQL and compare the rows.

``python tests/compare.py [pattern ...]`` checks matching queries at
``$CHECK_SF_DIR`` (default sf0.01) and prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import fnmatch
import glob
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def differences(spark, con, query, sql, sf_dir) -> str | None:
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = normal(ours, df.columns), normal(theirs, names)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2]
        gone = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; only ours {extra}; only oracle {gone}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"ours {x} oracle {y}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from actiloom.session import configure

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    patterns = sys.argv[1:] or ["*"]
    bad = 0
    for name, query in queries.items():
        if not any(fnmatch.fnmatch(name, p) for p in patterns):
            continue
        begin = time.time()
        try:
            if name in oracles:
                found = differences(spark, con, query, oracles[name], sf_dir)
                note = "ok" if found is None else f"DIFF {found}"
            else:
                note = f"rows {query(spark, sf_dir).count()} (no oracle)"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - begin:6.2f}s {note}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
