"""Compare registered queries with their SQL on the same parquet files.

usage: python tools/check.py FOLDER [-q] [-plain] [name ...]
-q prints problems only; -plain uses a session with Spark's default settings.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelrank.queries import oracles, spark_queries  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v))
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str).str.replace(" 00:00:00", "")
    return df.sort_values(list(df.columns), kind="stable", na_position="first").reset_index(drop=True)


def differences(
    spark_rows: pd.DataFrame, sql_rows: pd.DataFrame, allow_empty: bool = False
) -> str | None:
    a, b = canonical(spark_rows), canonical(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} != {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if len(a) == 0:
        return None if allow_empty else "no rows"
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            if x.dtype.kind != y.dtype.kind and not (x.isna().any() or y.isna().any()):
                return f"{c}: type {x.dtype} != {y.dtype}"
            x, y = x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan)
            bad = ~((x == y) | (np.isnan(x) & np.isnan(y)))
        else:
            bad = ~((x.astype(str) == y.astype(str)) | (x.isna() & y.isna())).to_numpy()
        if bad.any():
            i = int(np.flatnonzero(bad)[0])
            return f"{c}: {bad.sum()} of {len(a)} differ, e.g. {a.iloc[i].to_dict()} | {b.iloc[i].to_dict()}"
    return None


def main() -> int:
    from panelrank.session import local_session

    from pyspark.sql import SparkSession

    folder, names = sys.argv[1], [a for a in sys.argv[2:] if not a.startswith("-")]
    plain = "-plain" in sys.argv
    spark = SparkSession.builder.master("local[8]").getOrCreate() if plain else local_session()
    con = connect(folder)
    queries, sql = spark_queries(), oracles()
    failed = []
    for name in names or queries:
        began = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - began
            if name in sql:
                began = time.time()
                problem = differences(got, con.execute(sql[name]).df())
                sql_took = time.time() - began
            else:
                problem, sql_took = (None if len(got) else "no rows"), 0.0
        except Exception as error:  # noqa: BLE001
            took, sql_took, problem = time.time() - began, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            failed.append(name)
        if not problem and "-q" in sys.argv:
            continue
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {took:6.2f}s {sql_took:5.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
