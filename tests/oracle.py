"""Run queries next to their SQL on DuckDB: `python tests/oracle.py [sf dir] [names...]`."""

from __future__ import annotations

import collections
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], collections.Counter(tuple(repr(_plain(r[i])) for i in order) for r in rows)


def compare(df, connection, sql: str) -> str | None:
    """None if names, types of values and rows agree, else what differs."""
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    sql_names, wanted = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if got != wanted:
        extra, missing = list((got - wanted).items())[:3], list((wanted - got).items())[:3]
        return f"rows {sum(got.values())} vs {sum(wanted.values())}; spark only {extra}; sql only {missing}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from arrayflow.session import build
    spark = build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        begin = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, connection, oracles[name]) if name in oracles else f"(no SQL, {df.count()} rows)"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None and not problem.startswith("(")
        print(f"{name:24s} {time.time() - begin:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
