"""Run a registered query on Spark and its SQL on DuckDB and compare."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(path):
    db = duckdb.connect()
    for f in glob.glob(os.path.join(path, "*.parquet")):
        name = os.path.basename(f)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return db


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def _rows(frame, names):
    rows = [tuple(_cell(v) for v in r) for r in frame[names].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def difference(spark_frame, oracle_frame):
    """None when equal, else a short text."""
    a, b = sorted(spark_frame.columns), sorted(oracle_frame.columns)
    if a != b:
        return f"columns {a} != {b}"
    if len(spark_frame) != len(oracle_frame):
        return f"rows {len(spark_frame)} != {len(oracle_frame)}"
    left, right = _rows(spark_frame, a), _rows(oracle_frame, a)
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    if not bad:
        return None
    x, y = bad[0]
    cells = [(n, p, q) for n, p, q in zip(a, x, y) if p != q]
    return f"{len(bad)} of {len(left)} rows differ, first {cells[:4]}"
