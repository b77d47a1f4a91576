"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.queries import jobs, logs, raster, store, stream, tiles, usage, vector

MODULES = (usage, tiles, logs, store, vector, raster, stream, jobs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        repeated = out.keys() & module.QUERIES.keys()
        if repeated:
            raise ValueError(f"query names used twice: {sorted(repeated)}")
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out.update(module.SQL)
    return out
