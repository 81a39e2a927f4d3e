"""Named query catalogue: each entry builds a DataFrame from (spark, sf_dir).

Entries that SQL can express also carry an equivalent DuckDB query over the
same parquet tables; the two are compared row for row at a small scale.
Float outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


QUERIES: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        text = sql() if callable(sql) else sql
        QUERIES[name] = Query(name, fn, text, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from gradewell.plans import (  # noqa: F401
        fold_queries, io_queries, log_queries, model_queries, scoring_queries,
        sequence_queries, text_queries, vector_queries)
    return QUERIES
