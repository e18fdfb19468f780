"""Comparison of a query with its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A value in a form that both engines share."""
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return (v.astimezone(datetime.UTC).replace(tzinfo=None) if v.tzinfo else v).isoformat()
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def rows(table: pa.Table) -> list[str]:
    names = sorted(table.schema.names)
    return sorted(repr([plain(v) for v in row]) for row in zip(*[table.column(n).to_pylist() for n in names], strict=True))


def compare(spark, con, query, sql: str, sf_dir: str = SF) -> None:
    got, want = query(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    assert rows(got) == rows(want)
