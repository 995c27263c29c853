"""Run registered queries beside their SQL and compare rows, whatever their order."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None: columns by name, rows as a multiset of exact values."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    names = sorted(got.columns)
    for n in names:
        a, b = got[n].dtype.kind, want[n].dtype.kind
        if a != b:
            return f"column {n} has kind {a} against {b}"
    a, b = (
        frame[names].sort_values(names, ignore_index=True, na_position="first")
        for frame in (got, want)
    )
    for n in names:
        same = (a[n] == b[n]) | (a[n].isna() & b[n].isna())
        if not same.all():
            at = int((~same).idxmax())
            return f"{(~same).sum()} values of {n}: first {a.loc[at].to_dict()} against {b.loc[at].to_dict()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name in sql:
                started = time.time()
                diff = differences(got, connection.execute(sql[name]).df())
                note = "ok" if diff is None else f"DIFFERS {diff}"
                note += f" (sql {time.time() - started:.1f}s)"
            else:
                diff, note = None, "rows only"
        except Exception as error:  # noqa: BLE001
            diff, took = str(error), time.time() - started
            note = f"FAILS {str(error)[:600]}"
            got = []
        bad += diff is not None
        print(f"Q {name}: {len(got)} rows, {took:.1f}s, {note}", flush=True)
    print(f"Q {bad} of {len(names or queries)} wrong", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
