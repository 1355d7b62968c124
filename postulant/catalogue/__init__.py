"""Registered queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from postulant.catalogue import binary, browsing, ingesting, responses, statistics, storing, texts, upserting

    merged: dict[str, Query] = {}
    for module in (statistics, browsing, upserting, texts, responses, ingesting, binary, storing):
        merged |= module.QUERIES
    return merged


def all_sql() -> dict[str, str]:
    from postulant.catalogue import binary, browsing, ingesting, responses, statistics, storing, texts, upserting

    merged: dict[str, str] = {}
    for module in (statistics, browsing, upserting, texts, responses, ingesting, binary, storing):
        merged |= module.SQL
    return merged
