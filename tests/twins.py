"""Compares a query with its SQL twin on DuckDB."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return c


def differences(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert len(got) == len(want), (len(got), len(want))
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    out = {}
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            x, y = a[c].astype("float64"), b[c].astype("float64")
            bad = ~(((x - y).abs() <= 1e-6 * (1 + y.abs())) | (x.isna() & y.isna()))
        else:
            bad = a[c].astype(str) != b[c].astype(str)
        if bad.any():
            out[c] = (int(bad.sum()), a[c][bad].head(3).tolist(), b[c][bad].head(3).tolist())
    return out
