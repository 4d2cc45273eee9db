"""Registered queries: name -> (Spark callable, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers the decorated ``(spark, sf_dir) -> DataFrame``; ``covers`` lists operator ids."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(fn, sql, tuple(covers.split()))
        return fn
    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded at the edge of a query; never inside a computation."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in cols]
