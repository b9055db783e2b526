"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cards, checks, detection, imports, ingest, spending, upkeep  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

FLAGSHIP = "category_month_share"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
