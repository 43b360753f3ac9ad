"""Compare a Spark result with a DuckDB result, ignoring row order."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        s = out[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            out[c] = s.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(s):
            out[c] = s.astype(object)
        elif pd.api.types.is_numeric_dtype(s):
            out[c] = s.astype("float64") + 0.0
        else:
            out[c] = s.map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v)[:19] if hasattr(v, "isoformat") else v)
    return out.sort_values(list(out.columns), na_position="first", kind="stable", key=lambda s: s.astype(str)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> list[str]:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(duck_df.columns)}"]
    if len(spark_df) != len(duck_df):
        return [f"rows {len(spark_df)} vs {len(duck_df)}"]
    a, b = canonical(spark_df), canonical(duck_df)
    out = []
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = (~same).idxmax()
            out.append(f"{c}: {(~same).sum()} rows differ, e.g. {a[c][at]!r} vs {b[c][at]!r}")
    return out
