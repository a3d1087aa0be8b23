"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.operators import catalog
from attestry.plans import dataset_catalog, evidence_catalog

CATALOGS = [catalog, dataset_catalog, evidence_catalog]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for c in CATALOGS for k, q in c.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: q for c in CATALOGS for k, q in c.SQL.items()}
