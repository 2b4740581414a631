"""The list of named queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans.standins import check_sql


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, folder) under its name, with its check SQL."""

    def register(run):
        key = name or run.__name__
        if key in REGISTRY:
            raise ValueError(f"two queries are named {key}")
        REGISTRY[key] = Query(run, check_sql(sql) if sql else None)
        return run

    return register
