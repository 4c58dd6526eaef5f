"""All registered queries with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.plans.inputs import checking_sql

MODULES = ["profile", "events", "documents", "privacy", "sessions", "anomalies", "drift", "alerts", "streams", "files",
           "models", "stored"]


def _loaded():
    for name in MODULES:
        try:
            yield importlib.import_module(f"lumenframe.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"lumenframe.plans.{name}":
                raise


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for module in _loaded() for q in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: checking_sql(body) for module in _loaded() for name, body in module.SQL.items()}
