"""Compare catalogue queries with their oracle SQL on one scale."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.12g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def compare(con, sql: str, df) -> str | None:
    """None when equal, else a short explanation."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    pos = [names.index(n) for n in order]
    want = Counter(tuple(norm(r[i]) for i in pos) for r in want_rows)
    got = Counter(tuple(norm(r[n]) for n in order) for r in df.collect())
    if want == got:
        return None
    extra, missing = got - want, want - got
    return (f"rows {sum(got.values())} vs {sum(want.values())}; cols {order}; only spark {list(extra)[:3]}; "
            f"only oracle {list(missing)[:3]}")


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0]
    only = argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = duck(sf), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            if name in oracle:
                problem = compare(con, oracle[name], df)
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
