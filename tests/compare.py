"""Row-by-row comparison of a query with its SQL twin."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides hold the same rows under the same column names."""
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    theirs = _bag(theirs_cols, cur.fetchall())
    if sorted(spark_df.columns) != sorted(theirs_cols):
        return [f"columns {sorted(spark_df.columns)} against {sorted(theirs_cols)}"]
    ours = _bag(spark_df.columns, spark_df.collect())
    out = [f"only spark {n}x {r}" for r, n in (ours - theirs).items()]
    return out + [f"only sql {n}x {r}" for r, n in (theirs - ours).items()]
