"""Run registered queries beside their SQL on DuckDB and compare the results.

    python tools/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import duckdb  # noqa: E402

from harrow.session import local_session  # noqa: E402
from workload.registry import TABLES, load  # noqa: E402

SPARK_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
}


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return repr([canonical(v) for v in value])
    return repr(value)


def close(left, right):
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, rel_tol=1e-6, abs_tol=1e-9)
    return left == right


def compare(df, sql, connection):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    order = sorted(names)
    if sorted(df.columns) != order:
        return f"columns {sorted(df.columns)} vs {order}"
    problems = []
    for name, kind in df.dtypes:
        if SPARK_KIND.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} vs {kinds[name]}")
    place = [names.index(n) for n in order]
    right = [tuple(r[i] for i in place) for r in cursor.fetchall()]
    left = [tuple(r[n] for n in order) for r in df.select(*order).collect()]
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    a = sorted(tuple(canonical(v) for v in r) for r in left)
    b = sorted(tuple(canonical(v) for v in r) for r in right)
    if a != b:
        only_left = sorted(set(a) - set(b))[:3]
        only_right = sorted(set(b) - set(a))[:3]
        problems.append(f"values differ\n   cols  {order}\n   spark {only_left}\n   sql   {only_right}")
    if not left:
        problems.append("no rows")
    return "; ".join(problems) or f"ok {len(left)} rows"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module")
    parser.add_argument("--sql-only", action="store_true", help="leave out queries without SQL")
    parser.add_argument("--no-sql", action="store_true", help="only queries without SQL")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    entries = load()
    picked = [
        e for e in entries.values()
        if (not args.names or e.name in args.names)
        and not (args.sql_only and not e.sql)
        and not (args.no_sql and e.sql)
        and (not args.module or e.module in args.module.split(","))
    ]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    connection.execute("SET timezone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for entry in picked:
        start = time.time()
        try:
            df = entry.run(spark, folder)
            if entry.sql:
                verdict = compare(df, entry.sql, connection)
            else:
                n = len(df.collect())
                verdict = f"ok {n} rows, no sql" if n else "no rows"
        except Exception as error:  # report and go on
            verdict = "ERROR " + "".join(traceback.format_exception_only(error))[:1500]
        if not verdict.startswith("ok"):
            bad += 1
        print(f"{entry.name} [{time.time() - start:.1f}s]: {verdict}", flush=True)
    print(f"{len(picked) - bad} of {len(picked)} good")


main()
