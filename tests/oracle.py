"""Spark-vs-DuckDB comparison, the same check the driver runs.

Usage: ``python -m tests.oracle /root/testdata/sf0.01 [query ...]``
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    out = {"query": name, "rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    out["oracle_rows"] = len(o_rows)
    if sorted(s_cols) != sorted(o_cols):
        out["status"] = f"SCHEMA spark={sorted(s_cols)} oracle={sorted(o_cols)}"
        return out
    ds, do = digest(s_cols, s_rows), digest(o_cols, o_rows)
    out["status"] = "ok" if ds == do else "VALUES"
    if ds != do:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_o = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
        a = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
        b = sorted("|".join(_norm(r[i]) for i in order_o) for r in o_rows)
        only_s = sorted(set(a) - set(b))[:3]
        only_o = sorted(set(b) - set(a))[:3]
        out["cols"] = sorted(s_cols)
        out["only_spark"] = only_s
        out["only_oracle"] = only_o
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from keyroll.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(E.queries())
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, qs[n], sqls.get(n), sf_dir, con)
        except Exception as exc:  # report and continue
            r = {"query": n, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
