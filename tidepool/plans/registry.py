"""Names of operators, their query over the domain's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tidepool.plans.views import with_views
from tidepool.sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorates a function from the domain's tables to a result."""

    def wrap(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, folder: f(Domain(spark, folder))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = with_views(sql)
        return f

    return wrap


def scalar(name: str, view: str, key: str, column: Callable[[], Column], sql: str | None) -> None:
    """A function applied to every row of a view: (key, value)."""
    raw = view in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
    register(name, f"SELECT {key}, {sql} AS value FROM {view}" if sql else None)(lambda d: (d.raw(view) if raw else getattr(d, view)()).select(*key.split(", "), column().alias("value")))


def iso(x: str) -> str:
    """DuckDB: an instant as text."""
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def local(x: str) -> str:
    """DuckDB: wall clock of an instant."""
    return f"(({x})::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')"


def utc(w: str) -> str:
    """DuckDB: some instant of a wall clock."""
    return f"(({w})::TIMESTAMP AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC')"


def candidates(w: str, which: str) -> str:
    """DuckDB: first (least) or last (greatest) instant at which the wall shows this clock."""
    near = [f"{utc(w)} - INTERVAL 1 HOUR", utc(w), f"{utc(w)} + INTERVAL 1 HOUR"]
    return f"{which}({', '.join(f'CASE WHEN {local(x)} = ({w}) THEN {x} END' for x in near)})"


def state(now: str) -> str:
    """DuckDB: lifecycle state of a campaign."""
    return f"""CASE WHEN cancelled_at IS NOT NULL THEN 'cancelled' WHEN published_at IS NULL OR starts_at IS NULL OR ends_at IS NULL THEN 'draft'
      WHEN ended_at IS NOT NULL AND least(ends_at, ended_at) <= starts_at THEN 'ended' WHEN least(ends_at, ended_at) <= starts_at THEN 'draft'
      WHEN {now} < starts_at THEN 'scheduled' WHEN {now} < least(ends_at, ended_at) THEN 'live' ELSE 'ended' END"""
