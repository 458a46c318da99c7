"""Run registered queries beside their SQL and compare the results value by value."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        s = df[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            s = s.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(s):
            s = s.astype(object).map(lambda v: None if pd.isna(v) else str(bool(v)))
        elif pd.api.types.is_numeric_dtype(s):
            s = s.astype("float64")
        else:
            s = s.astype(object).map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
        out[c] = s
    plain = pd.DataFrame(out)
    return plain.sort_values(list(plain.columns), kind="stable", na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = _plain(got), _plain(want)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            at = int(np.argmin(same.to_numpy()))
            return f"column {c} ({got[c].dtype}/{want[c].dtype}), sorted row {at}: {a.iloc[at].to_dict()} against {b.iloc[at].to_dict()}"
    return None


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from rowassay.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            took = time.time() - started
            if name not in oracle:
                print(f"rows  {name:28s} {len(got):7d} {took:6.1f}s", flush=True)
                continue
            started = time.time()
            problem = difference(got, con.execute(oracle[name]).df())
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            problem, took = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - started
            got = ()
        bad += problem is not None
        print(f"{'ok   ' if problem is None else 'WRONG'} {name:28s} {len(got):7d} {took:6.1f}s {time.time() - started:6.1f}s {problem or ''}", flush=True)
    print(f"{bad} wrong of {len(chosen)}")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
