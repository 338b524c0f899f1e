"""Compare queries with their SQL on the same tables: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def _plain(v):
    """Floats to twelve digits; not-a-number equals nothing, as for the driver, so a query has to say what it gives for it."""
    if isinstance(v, float):
        return float("nan") if v != v else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return v


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if the query and its SQL give the same rows, else what differs."""
    df = query(spark, sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got, want = bag(df.columns, df.collect()), bag(names, rel.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as e

    from slabworks.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, sql in e.oracle_sql().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            what = differences(spark, con, name, e.queries()[name], sql, sf_dir)
        except Exception as x:  # noqa: BLE001
            what = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(what)
        print(f"{'DIFF' if what else 'ok  '} {name} {time.time() - t:.1f}s {what}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
