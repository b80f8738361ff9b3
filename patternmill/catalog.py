"""All queries of the engine's own operators with the SQL that answers the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patternmill.plans import core, mining, relational, structure

PLANS = (core, relational, mining, structure)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, (f, _) in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, (_, sql) in plan.QUERIES.items() if sql}
