"""Compare registered queries with their SQL twins in DuckDB; run as a script or from tests."""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_TO_DUCK = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _norm(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def compare(spark, con, sf_dir, function, sql):
    """An empty list when rows, names and types agree, else what differs."""
    start = time.time()
    df = function(spark, sf_dir)
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    seconds = time.time() - start
    if sql is None:
        return ([] if rows else ["no rows"]), len(rows), seconds
    cursor = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})")
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    duck_columns = sorted(d[0] for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description)
    problems = []
    if names != duck_columns:
        problems.append(f"columns {names} vs {duck_columns}")
    for field in df.schema:
        want = SPARK_TO_DUCK.get(field.dataType.simpleString())
        if want and types[field.name] != want:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} vs {types[field.name]}")
    left = sorted((tuple(_norm(v) for v in r) for r in rows), key=_key)
    right = sorted((tuple(_norm(v) for v in r) for r in expected), key=_key)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    elif left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        problems.append(f"{len(bad)} rows differ, such as {bad[0]}")
    return problems, len(left), seconds


def main(argv):
    import __spark_entry__ as entry
    from transit_spark.session import build_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv or queries:
        try:
            problems, n, seconds = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problems, n, seconds = [f"{type(error).__name__}: {str(error)[:1500]}"], 0, 0.0
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {seconds:.1f}s {'' if name in oracles else '(rows only)'}")
        for p in problems:
            print("     ", p[:1800])
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
