"""Compare registered queries with their SQL on DuckDB: ``python -m barloom.plans.check FOLDER [prefix ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

from barloom.plans import registry
from barloom.session import build_session


def normal(frame):
    """Sort columns and rows, render values so that equal results compare equal."""
    import pandas as pd

    def show(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return "NULL"
        if hasattr(v, "tolist") and not isinstance(v, (str, float)):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(show(x) for x in v) + "]"
        if isinstance(v, float):
            return "NULL" if v != v else repr(v)
        return str(v)

    frame = frame[sorted(frame.columns)]
    out = pd.DataFrame({c: frame[c].astype(object).map(show) for c in frame.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark, con, folder: str, name: str):
    started = time.time()
    df = registry.QUERIES[name](spark, folder)
    got = normal(df.toPandas())
    spent = time.time() - started
    sql = registry.ORACLES.get(name)
    if sql is None:
        return ("rows", spent, len(got), None)
    want = normal(con.execute(sql).fetchdf())
    if list(got.columns) != list(want.columns):
        return ("COLUMNS", spent, len(got), f"{list(got.columns)} vs {list(want.columns)}")
    if len(got) != len(want):
        return ("COUNT", spent, len(got), f"{len(got)} vs {len(want)}")
    diff = (got != want).any(axis=1)
    if diff.any():
        i = diff[diff].index[0]
        cols = [c for c in got.columns if got.at[i, c] != want.at[i, c]]
        return (
            "VALUES", spent, len(got),
            f"{int(diff.sum())} rows; first: {[(c, got.at[i, c], want.at[i, c]) for c in cols]}",
        )
    return ("ok", spent, len(got), None)


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def main(argv: list[str]) -> int:
    folder, prefixes = argv[0], argv[1:]
    registry.load_all()
    spark = build_session(
        "check", os.environ.get("CHECK_MASTER", "local[8]"), spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(folder), 0
    for name in registry.QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, spent, rows, note = compare(spark, con, folder, name)
        except Exception as exc:  # report and go on
            status, spent, rows, note = "ERROR", 0.0, 0, str(exc).replace("\n", " ")[:600]
        bad += status not in ("ok", "rows")
        flag = "  EMPTY" if rows == 0 and status in ("ok", "rows") else ""
        print(f"{status:8}{name:34}{spent:6.1f}s {rows:7} {note or ''}{flag}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
