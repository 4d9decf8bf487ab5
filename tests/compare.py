"""Run registered queries beside their SQL in DuckDB: python tests/compare.py FOLDER NAME..."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the tables of a folder as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(folder, f"{t}.parquet").exists():
            one = Path(folder, f"{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{one}{'/*.parquet' if one.is_dir() else ''}')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns by name, values as plain text, sorted."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v: object) -> str:
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(plain, v)) + "]"
        return str(v)

    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def difference(spark, con, folder: str, query, sql: str) -> str:
    """Empty if a query and its SQL give the same columns and rows; else what differs first."""
    (a_cols, a), (b_cols, b) = spark_rows(query(spark, folder)), sql_rows(con, sql)
    if sorted(a_cols) != sorted(b_cols):
        return f"columns {sorted(a_cols)} and {sorted(b_cols)}"
    a, b = canonical(a_cols, a), canonical(b_cols, b)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows, {sorted(a_cols)}; {next(((x, y) for x, y in zip(a, b) if x != y), 'a prefix')}"


def main(folder: str, names: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), e.oracle_sql()
    for name, f in e.queries().items():
        if names and not any(name == n or n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        began = time.time()
        try:
            said = difference(spark, con, folder, f, sql[name]) or "same" if name in sql else f"{len(f(spark, folder).collect())} rows, no SQL"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{time.time() - began:6.1f} s  {name}: {said[:1800]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
