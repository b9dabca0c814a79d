"""All registered queries of the library, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomkb.plans import casework, commits, registers, registries, relational, retrieval, search, text

#: Every module has QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES = (search, relational, text, registries, casework, commits, retrieval, registers)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
