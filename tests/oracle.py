"""Run registered queries next to their SQL in DuckDB and compare the results.

    python -m tests.oracle sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import signal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
LIMIT = int(os.environ.get("TESSERA_QUERY_SECONDS", "150"))
DATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata")


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(
        (tuple(plain(r[n]) for n in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r)
    )


TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]",
    "array<bigint>": "BIGINT[]", "float": "FLOAT", "array<int>": "INTEGER[]",
}


def compare(spark, con, folder, name, fn, sql):
    """Return an error text, or an empty one when both sides agree."""
    df = fn(spark, folder)
    rows = df.collect()
    if sql is None:
        return "" if rows else "no rows"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(cols)}"
    mine = {f.name: TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if mine != types:
        return f"types differ: { {c: (mine[c], types[c]) for c in cols if mine[c] != types[c]} }"
    a, b = table(df.columns, rows), table(cols, want)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} / {len(b)}"
    if not a:
        return "no rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""


def stop(*_):
    raise TimeoutError("query took too long")


def main(argv):
    signal.signal(signal.SIGALRM, stop)
    import __spark_entry__ as entry
    from tessera.session import local_session

    folder = f"{DATA}/{argv[0] if argv else 'sf0.01'}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = 0
    for name in names:
        t = time.time()
        signal.alarm(LIMIT)
        try:
            error = compare(spark, con, folder, name, queries[name], sql.get(name))
        except Exception as e:  # report and go on with the next query
            error = f"{type(e).__name__}: {str(e)[:700]}"
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        failed += bool(error)
        print(f"{'FAIL' if error else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in sql else '(rows only) '}{error}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
