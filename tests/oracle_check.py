"""Compare registered queries with their SQL on the same tables. Usage: oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from lexweave.plans.base import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(got)} rows, {t1 - t0:.1f}s"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, oracle {t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        extra = list(set(got) - set(want))[:2]
        missing = list(set(want) - set(got))[:2]
        return False, f"{note}; oracle {len(want)} rows\n  only spark: {extra}\n  only oracle: {missing}"
    return True, note


def main() -> int:
    import __spark_entry__ as entry
    from lexweave.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.checkpoint.dir": Path(tempfile.mkdtemp()).as_uri(), "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    todo = [n for n in entry.queries() if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    for n in todo:
        try:
            ok, note = compare(spark, con, sf_dir, n)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, note, flush=True)
    print(f"{len(todo)} checked, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
