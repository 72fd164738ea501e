"""Run registered queries next to their SQL: ``python -m tests.oracle_check [sf_dir] [query ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("reviewlens")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.perf_counter()
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ours = sorted_rows([tuple(r) for r in df.select(*names).collect()])
    took = time.perf_counter() - start
    if sql is None:
        return bool(ours), f"{len(ours)} rows, no oracle, {took:.1f} s"
    relation = con.sql(sql)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    if sorted(relation.columns) != names:
        return False, f"columns {names} vs {sorted(relation.columns)}"
    theirs = sorted_rows(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    same_type = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    off = {n: (types[n], kinds[n]) for n in names if same_type.get(types[n]) != kinds[n]}
    if off:
        return False, f"types {off}"
    if len(ours) != len(theirs):
        return False, f"{len(ours)} rows vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(ours)} rows differ, first: {str(bad[0])[:600]}"
    return True, f"{len(ours)} rows, {took:.1f} s"


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            ok, note = compare(spark, con, query, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
