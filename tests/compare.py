"""Compares a DataFrame with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def _close(a, b) -> bool:
    return a == b or (isinstance(a, float | int) and isinstance(b, float | int) and abs(a - b) <= 2e-6 * max(1.0, abs(b)))


def assert_same(df, sql: str, sf_dir: str) -> int:
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=str)
    got = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(_close, g, w))]
    assert not bad, bad[:3]
    return len(got)
