"""Named queries over the test tables, one module per operator family, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import compose, corpus, diagnose, extras, lexical, models, relational, report, vectors

FAMILIES = [corpus.family, vectors.family, lexical.family, diagnose.family, compose.family, report.family, relational.family, extras.family, models.family]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
