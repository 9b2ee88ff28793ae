"""Run registered queries against their check SQL and compare whole results.

Usage: python tools/check.py SF_DIR [name-part ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from claimbook.catalog import all_queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="claimbook-check-"))
        .getOrCreate()
    )


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def tidy(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sort_key(row):
    return tuple((x is not None, type(x).__name__ in ("str",), str(x)) for x in row)


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(tidy(r[i]) for i in order) for r in rows), key=sort_key
    )


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def main() -> int:
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = session(), views(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = q.build(spark, sf_dir)
            got_names, got = ordered(df.columns, [tuple(r) for r in df.collect()])
            types = {f.name: f.dataType.simpleString() for f in df.schema}
        except Exception as error:  # report and go on
            bad += 1
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows  {name}: {len(got)} rows, no SQL ({took:.1f}s)", flush=True)
            continue
        try:
            cursor = con.execute(q.sql)
            want_types = {d[0]: str(d[1]) for d in cursor.description}
            want_names, want = ordered([d[0] for d in cursor.description], cursor.fetchall())
        except Exception as error:
            bad += 1
            print(f"SQL   {name}: {str(error)[:600]}", flush=True)
            continue
        if got_names == want_names and got == want:
            state = "ok   "
        elif got_names == want_names and len(got) == len(want) and all(
            close(a, b) for x, y in zip(got, want) for a, b in zip(x, y)
        ):
            state = "NEAR "
            bad += 1
        else:
            state = "DIFF "
            bad += 1
        print(f"{state} {name}: {len(got)} rows ({took:.1f}s)", flush=True)
        kinds = {n: (types[n], want_types.get(n)) for n in types}
        odd = {
            n: k
            for n, k in kinds.items()
            if k[1] is None
            or {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN"}.get(k[0]) != k[1]
        }
        if odd:
            print(f"      types: {odd}")
        if state != "ok   ":
            print(f"      {got_names} / {want_names}, {len(got)} / {len(want)} rows")
            shown = 0
            for x, y in zip(got, want):
                if x != y:
                    print("      got ", x, "\n      want", y)
                    shown += 1
                    if shown == 2:
                        break
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
