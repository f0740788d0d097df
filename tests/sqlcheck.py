"""Run registered queries and compare them with their SQL on DuckDB.

    python tests/sqlcheck.py [scale] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_cell(x) for x in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, otherwise a short description."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows; e.g. {[x for x in a if x not in b][:2]} / {[x for x in b if x not in a][:2]}"
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if u == v:
                continue
            if isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-5):
                continue
            return f"{x} != {y} in {sorted(spark_frame.columns)}"
    return None


def types_of(con, sql: str) -> dict[str, str]:
    return {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}


EXPECTED = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def check(spark, con, name: str, folder: str) -> str | None:
    from stationflow.plans.catalog import QUERIES

    registered = QUERIES[name]
    df = registered.run(spark, folder)
    frame = df.toPandas()
    if registered.sql is None:
        return None if len(frame) else "no rows"
    kinds = types_of(con, registered.sql)
    wrong = {c: (t, kinds.get(c)) for c, t in df.dtypes if kinds.get(c) != EXPECTED.get(t)}
    found = difference(frame, con.execute(registered.sql).df())
    if found is None and wrong:
        return f"types {wrong}"
    if found is None and not len(frame):
        return "equal, but empty"
    return found


def main() -> int:
    from stationflow.plans.catalog import QUERIES
    from stationflow.session import build_session

    args = sys.argv[1:]
    scale = args[0] if args else "0.01"
    parts = args[1:]
    folder = f"/root/testdata/sf{scale}"
    spark = build_session(
        "sqlcheck", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            found = check(spark, con, name, folder)
        except Exception as error:  # report and go on
            found = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
    print(f"{bad} failed of {len(QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
