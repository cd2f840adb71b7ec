"""All bound queries with their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cantiere.plans import catalog_geo, catalog_io, catalog_link, catalog_score, catalog_text

_GROUPS = (catalog_score, catalog_text, catalog_link, catalog_geo, catalog_io)


def _entries() -> dict:
    out = {}
    for group in _GROUPS:
        out.update(group.ENTRIES)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql is not None}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    from cantiere.plans.catalog_score import operational_shortlist
    from cantiere.operators.topk import by_score

    return operational_shortlist(spark, sf).orderBy(*by_score(score="operational_score"))
