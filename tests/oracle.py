"""Run registered queries against their SQL in an in-process database and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value != 0 else "0"
    if isinstance(value, bool) or value is None:
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def kind(type_name: str) -> str:
    t = str(type_name).lower()
    if t in ("double", "float", "real"):
        return "float"
    if t.startswith("decimal"):
        return "decimal"
    if any(k in t for k in ("int", "long", "short", "byte")):
        return "int"
    return "bool" if t == "boolean" else "text" if t in ("string", "varchar") else t


def compare(con, spark, name, plan, sql, sf_dir):
    """('ok' or a description, Spark seconds, rows)."""
    start = time.time()
    df = plan(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return "rows only", took, len(got)
    rel = con.sql(sql)
    cols, types = list(rel.columns), [str(t) for t in rel.types]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", took, len(got)
    spark_kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    sql_kinds = {c: kind(t) for c, t in zip(cols, types)}
    bad = {c: (spark_kinds[c], sql_kinds[c]) for c in cols if spark_kinds[c] != sql_kinds[c]}
    if bad:
        return f"types {bad}", took, len(got)
    _, a = rows_of(df.columns, [tuple(r) for r in got])
    _, b = rows_of(cols, want)
    if a != b:
        extra, missing = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"{len(got)} vs {len(want)} rows, {sum((a - b).values())} differ; spark {extra} sql {missing}", took, len(got)
    return "ok", took, len(got)


def main(argv):
    import __spark_entry__ as entry
    from reachgrid.session import get_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sorted(plans):
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            verdict, took, n = compare(con, spark, name, plans[name], sqls.get(name), sf_dir)
        except Exception as exc:
            verdict, took, n = f"{type(exc).__name__}: {str(exc)[:600]}", 0, 0
        if verdict not in ("ok", "rows only"):
            failed += 1
        print(f"{'  ' if verdict in ('ok', 'rows only') else '!!'} {name:45} {took:6.2f}s {n:8d} {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
