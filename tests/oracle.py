"""Runs a query and its SQL side by side."""

import os

import duckdb
import numpy as np
import pandas as pd


def differences(spark, query, sql: str, folder: str) -> list[str]:
    """What differs between both results, columns by name and rows in the order of all columns."""
    connection = duckdb.connect()
    for name in os.listdir(folder):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    a, b = query(spark, folder).toPandas(), connection.sql(sql).df()
    if set(a.columns) != set(b.columns):
        return [f"columns {sorted(set(a.columns) ^ set(b.columns))}"]
    if len(a) != len(b):
        return [f"rows {len(a)} and {len(b)}"]
    columns = sorted(a.columns)
    keys = [c for c in columns if a[c].dtype != float and b[c].dtype != float] or columns
    order = lambda f: f[columns].sort_values(keys, key=lambda s: s.map(lambda v: '' if pd.isna(v) else str(v))).reset_index(drop=True)
    a, b, out = order(a), order(b), []
    for c in columns:
        if a[c].dtype == float or b[c].dtype == float:
            x, y = pd.to_numeric(a[c]).to_numpy(float), pd.to_numeric(b[c]).to_numpy(float)
            bad = ~(np.isclose(x, y, rtol=1e-6, atol=2e-6) | (np.isnan(x) & np.isnan(y)))
        else:
            bad = (a[c].isna() != b[c].isna()) | (a[c].notna() & (a[c].astype(str) != b[c].astype(str)))
        if bad.any():
            out.append(f"{c}: {int(bad.sum())} cells")
    return out
