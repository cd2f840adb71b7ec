"""Ordered reports and top-k lists.  The limit is the feature here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.operators.dedupe import top_per_key


def by_score(key: str = "cup", score: str = "commercial_score", value: str = "value_eur") -> list[Column]:
    """Score, value, then the key so that the order is total."""
    return [F.desc(F.coalesce(F.col(score), F.lit(0))), F.desc(F.coalesce(F.col(value), F.lit(0.0))), F.asc(key)]


def by_value(key: str = "cup", score: str = "commercial_score", value: str = "value_eur") -> list[Column]:
    a, b, k = by_score(key, score, value)
    return [b, a, k]


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_category(df: DataFrame, n: int = 20, category: str = "category", **names: str) -> DataFrame:
    keyed = df.withColumn(category, F.coalesce(F.col(category), F.lit("ND")))
    return top_per_key(keyed, [category], by_score(**names), n, rank="rank")


def mid_market(df: DataFrame, bounds: tuple[float, float] = P.MID_MARKET, n: int = 1000, value: str = "value_eur", **names: str) -> DataFrame:
    return top(df.filter(F.col(value).between(*bounds)), by_score(value=value, **names), n)


def local_public(df: DataFrame, n: int = 1000, client: str = "client", **names: str) -> DataFrame:
    return top(df.filter(D.is_local_client(F.col(client))), by_score(**names), n)


def macro(df: DataFrame, condition: Column, n: int = 1000, **names: str) -> DataFrame:
    return top(df.filter(condition), by_value(**names), n)


def shortlist(df: DataFrame, macro_: Column, min_score: int = P.SHORTLIST_SCORE, score: str = "operational_score") -> DataFrame:
    """Projects worth a call: not macro, score at least ``min_score`` (unordered)."""
    return df.filter(~macro_ & (F.col(score) >= min_score))


def national_view(df: DataFrame) -> DataFrame:
    """Shortlist columns under their published names."""
    from cantiere.functions.text import first_alias
    from cantiere.functions.values import money

    value = F.col("value_eur")
    if df.schema["value_eur"].dataType.typeName() == "string":
        value = money(value)
    return df.select(
        first_alias(df, "operational_score", "score").try_cast("int").alias("score"),
        first_alias(df, "primary_segment").alias("segment"),
        *["title", "category", "region", "province", "municipality"],
        F.coalesce(value, F.lit(0.0)).alias("value_eur"), "client", "cup", "source_url",
    )


def snapshot_top(snapshot: DataFrame, source: str | None = None, n: int = 120, only_active: bool = True) -> DataFrame:
    """Best active records of a snapshot: score, value, last seen."""
    rows = snapshot.filter("is_active") if only_active else snapshot
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    return top(rows, [F.desc_nulls_last("commercial_score"), F.desc_nulls_last("value_eur"),
                      F.desc_nulls_last("last_seen"), F.asc("record_key")], n)
