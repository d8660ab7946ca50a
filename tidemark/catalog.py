"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PLANS = ("plans.market", "plans.wallets", "plans.liquidity", "plans.research", "plans.experts", "plans.cells", "plans.gates", "plans.integrity", "plans.landed", "plans.kept", "plans.feeds", "plans.clocks", "plans.schedules", "streaming.jobs")


def _plans():
    return [importlib.import_module(f"tidemark.{name}") for name in _PLANS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in _plans() for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in _plans() for name, text in plan.SQL.items()}
