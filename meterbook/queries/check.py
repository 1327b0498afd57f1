"""Run registered queries on Spark and their SQL on DuckDB, and compare."""

from __future__ import annotations

import math
import sys
import time

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return str(value) if hasattr(value, "as_tuple") else value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, folder: str, q) -> tuple[str, str]:
    df = q.run(spark, folder)
    left = rows_of(df.columns, df.collect())
    if q.sql is None:
        return "rows-only", f"{len(left)} rows"
    cur = con.execute(q.sql)
    columns = [d[0] for d in cur.description]
    right = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return "FAIL", f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(left) != len(right):
        return "FAIL", f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return "FAIL", f"{sorted(columns)}\n   spark {a}\n   duck  {b}"
    return "ok", f"{len(left)} rows"


def main(argv: list[str]) -> int:
    from ..session import local_session
    from .registry import load

    folder = argv[0]
    names = argv[1:]
    spark = local_session("meterbook-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, q in load().items():
        if names and not any(n in name for n in names):
            continue
        began = time.time()
        try:
            status, note = compare(spark, con, folder, q)
        except Exception as error:  # noqa: BLE001 - report and go on
            status, note = "ERROR", str(error)[:1500]
        bad += status in ("FAIL", "ERROR")
        print(f"{status:9s} {name:32s} {time.time() - began:5.1f}s {note}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
