"""Run registered queries beside their SQL in DuckDB and compare rows.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def make_session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("tessera")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, query, sql: str | None, sf_dir: str) -> tuple[int, str]:
    """Row count and the first difference ('' when equal)."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(mine), ""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return len(mine), f"columns {sorted(df.columns)} != {sorted(names)}"
    other = rows_of(names, found.fetchall())
    if len(mine) != len(other):
        return len(mine), f"{len(mine)} rows != {len(other)}"
    for a, b in zip(mine, other):
        if a != b:
            return len(mine), f"{a} != {b}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return len(mine), f"types {[type(x).__name__ for x in a]} != {[type(x).__name__ for x in b]}"
    return len(mine), ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from catalog import oracle_sql, queries
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con, failed = make_session(), connect(sf_dir), 0
    sqls = oracle_sql()
    chosen = {n: q for n, q in queries().items() if not args.names or n in args.names}
    for name, query in chosen.items():
        start = time.time()
        try:
            count, gap = compare(spark, con, query, sqls.get(name), sf_dir)
        except Exception as e:
            traceback.print_exc(limit=3)
            count, gap = -1, f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(gap)
        state = "FAIL" if gap else ("ok" if name in sqls else "rows")
        print(f"{state:5}{name:22}{count:8} rows {time.time() - start:7.2f}s {gap[:900]}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
