"""Registry of named queries."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def importable(fn: Query) -> Query:
    """The query with this checkout on the import path of the Python workers, wherever the driver was started."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
        if here not in environment.get("PYTHONPATH", "").split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, environment.get("PYTHONPATH", ""))))
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = importable(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
