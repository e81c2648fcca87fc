"""Query registry shared by the catalog modules."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (and its SQL)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rollspark.functions.cols.rnd``."""
    s = f"{10 ** digits}.0"
    return f"(floor(CAST(({expr}) AS DOUBLE) * {s} + 0.5001220703125) / {s})"
