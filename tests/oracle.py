"""Compares Spark results with DuckDB's, whatever the order of rows and columns."""

import math
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, (float, np.floating)) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, (bool, np.bool_)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else float(f"{v:.9g}")
    return int(v) if isinstance(v, np.integer) else str(v) if not isinstance(v, int) else v


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(_plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)
