"""Run registered queries beside their DuckDB twins and compare the rows.

    python -m tests.oracle [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

SF = "/root/testdata/sf0.01"


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value if value != 0 else 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(df, con, sql):
    """None when equal, else a short description."""
    spark_rows = df.collect()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    duck_rows = rel.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    a, b = canon(df.columns, spark_rows), canon(columns, duck_rows)
    if a == b:
        kinds = [
            (n, t1, t2) for n, t1, t2 in type_gaps(df, rel_types(con, sql)) if t1 != t2
        ]
        return f"(types {kinds})" if kinds else None
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} rows differ, of {len(a)}; {sorted(columns)}\n   spark {str(diff[0][0])[:400]}\n   duck  {str(diff[0][1])[:400]}"


def rel_types(con, sql):
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def type_gaps(df, duck_types):
    for name, kind in df.dtypes:
        yield name, SAME.get(kind, kind), duck_types[name]


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from proplytics.session import local_session

    sf_dir = argv[0] if argv else SF
    prefixes = argv[1:]
    spark, con = local_session(8), duck(sf_dir)
    twins, bad = oracle_sql(), 0
    for name, run in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in twins:
                verdict = compare(df, con, twins[name])
            else:
                verdict = f"(rows only: {len(df.collect())})"
        except Exception as error:  # report and go on
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        if verdict and not verdict.startswith("("):
            bad += 1
        mark = "ok" if verdict is None else verdict
        print(f"{time.time() - start:6.2f}s {name}: {mark}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
