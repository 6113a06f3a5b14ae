"""Run queries on Spark and their SQL on DuckDB, and report what differs: python tests/verify.py SF_DIR [NAME...]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, columns):
    def plain(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan", "None"):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            f = float(v)
            return f"{f:.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


def compare(spark, con, name, fn, sql, sf_dir):
    got = fn(spark, sf_dir).toPandas()
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows(got, sorted(got.columns)), rows(want, sorted(got.columns))
    if a != b:
        return f"{len(a)} rows, expected {len(b)}; first differing {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
    return ""


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import time

    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    sf_dir, names, con = sys.argv[1], sys.argv[2:], connect(sys.argv[1])
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and name not in names or not names and name.startswith(("op", "pipeline")) and name not in oracles:
            continue
        t = time.time()
        try:
            said = compare(spark, con, name, fn, oracles[name], sf_dir) if name in oracles else f"{fn(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__} {str(e)[:500]}"
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
