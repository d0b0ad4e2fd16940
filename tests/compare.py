"""Runs registered queries beside their SQL: python tests/compare.py [--sf sf0.01] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def kind(t: str) -> str:
    t = t.lower()
    if "int" in t:
        return "int"
    return {"double": "float", "float": "float", "varchar": "string"}.get(t, t.split("(")[0])


def compare(spark, con, name: str, run, sql: str, sf_dir: str) -> str:
    """Empty if rows, columns and types agree, else what differs."""
    want = con.sql(sql)
    names = sorted(want.columns)
    df = run(spark, sf_dir)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    types = {c: (kind(dict(df.dtypes)[c]), kind(str(t))) for c, t in zip(want.columns, want.types, strict=True)}
    if odd := {c: t for c, t in types.items() if t[0] != t[1]}:
        return f"types {odd}"
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    order = [want.columns.index(c) for c in names]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    if len(got) != len(expected):
        return f"{len(got)} and {len(expected)} rows"
    odd = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    return f"{len(odd)} of {len(got)} rows differ, such as {odd[0]}"[:600] if odd else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "sf0.01"
    names = [a for a in args if a != "--sf"]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con, sqls, bad = database(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, run, sqls[name], sf_dir) if name in sqls else f"rows only: {run(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:500]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name:28s} {time.time() - began:6.1f} s  {said or 'equal'}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
