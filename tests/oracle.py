"""Runs a query and its SQL side by side and compares columns, rows and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).iterdir()):
        at = p if p.is_file() else p / "*.parquet"
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def _value(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x + 0.0:.9g}")
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return tuple(_value(v) for v in (x.tolist() if hasattr(x, "tolist") else x))
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = [[_value(v) for v in frame[c].tolist()] for c in sorted(frame.columns)]
    return sorted(zip(*cols), key=lambda r: tuple((v is not None, str(type(v)), v if not isinstance(v, bool) else int(v)) for v in r)) if cols else []


def compare(spark, con, query, sql: str, sf_dir: str) -> int:
    """The number of rows, if all is equal."""
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns), (sorted(ours.columns), sorted(theirs.columns))
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    a, b = rows(ours), rows(theirs)
    wrong = [(x, y) for x, y in zip(a, b) if not _same(x, y)]
    assert not wrong, (len(wrong), len(a), sorted(ours.columns), wrong[:3])
    return len(ours)


def _same(x: tuple, y: tuple) -> bool:
    return all(p == q or (isinstance(p, float) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-7, abs_tol=1e-9)) for p, q in zip(x, y))
