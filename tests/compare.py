"""Run registered queries beside their SQL and compare rows, columns and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, func, sql, sf_dir) -> str:
    """Empty when equal, else what differs."""
    df = func(spark, sf_dir)
    columns, rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    wanted_columns, wanted = _rows(names, res.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} vs {wanted_columns}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows vs {len(wanted)}"
    if not rows:
        return "no rows"
    bad = [(a, b) for a, b in zip(rows, wanted) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ on {columns}, first {bad[0][0]} vs {bad[0][1]}"
    types = {type(x).__name__ for r in rows[:50] for x in r}, {type(x).__name__ for r in wanted[:50] for x in r}
    return f"types {types}" if types[0] != types[1] else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from fieldcast.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, func in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, name, func, sqls[name], sf_dir) or "ok"
            else:
                verdict = f"rows only: {func(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            verdict = "ERROR " + str(e)[:600]
        failed += verdict != "ok" and not verdict.startswith("rows only")
        print(f"{name:34s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed", failed)
