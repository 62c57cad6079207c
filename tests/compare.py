"""Run registered queries next to their SQL in DuckDB. Usage: python tests/compare.py [folder] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def compare(spark, con, folder, name, queries, oracle):
    df = queries[name](spark, folder)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracle:
        return ("rows-only", f"{len(got[1])} rows")
    rel = con.sql(oracle[name])
    want = table_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return ("COLUMNS", f"{got[0]} vs {want[0]}")
    types = {c: (KIND.get(t, t), str(w)) for (c, t), w in zip(df.dtypes, [dict(zip(rel.columns, rel.types))[c] for c in df.columns])}
    odd = {c: t for c, t in types.items() if t[0] != t[1]}
    if len(got[1]) != len(want[1]):
        return ("ROWS", f"{len(got[1])} vs {len(want[1])}; {got[1][:2]} vs {want[1][:2]}")
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return ("VALUES", f"{len(bad)} of {len(got[1])}; {got[0]}; " + "; ".join(f"{g} vs {w}" for g, w in bad[:3]))
    return ("types" if odd else "ok", f"{len(got[1])} rows" + (f" {odd}" if odd else ""))


if __name__ == "__main__":
    from conftest import make_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    failed = 0
    for n in names:
        start = time.time()
        try:
            status, note = compare(spark, con, folder, n, queries, oracle)
        except Exception as e:  # report and go on
            status, note = "ERROR", f"{type(e).__name__}: {str(e)[:700]}"
        failed += status not in ("ok", "rows-only", "types")
        print(f"{status:9} {time.time() - start:6.2f}s {n}: {note}"[:1500], flush=True)
    print(f"{len(names)} queries, {failed} failed")
