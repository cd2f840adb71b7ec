"""Faceted search over the master."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantiere.functions.text import blank_to_null
from cantiere.operators.geo import branch_list

TEXT_COLUMNS = ("title", "client", "contractors", "contractor_tax_codes", "cup", "cig", "municipality", "province",
                "region", "branch", "branch_candidates")
NATIONAL_TEXT_COLUMNS = ("title", "client", "cup", "region", "province", "municipality", "segment")


@dataclass(frozen=True)
class SearchRequest:
    """Empty or zero fields are unset."""

    branch: str = ""
    region: str = ""
    province: str = ""
    municipality: str = ""
    segment: str = ""
    value_min: float = 0.0
    value_max: float = 0.0
    date_from: str = ""
    date_to: str = ""
    text: str = ""
    change_status: str = ""


def predicate(request: SearchRequest, text_columns: Sequence[str] = TEXT_COLUMNS, value: str = "value_eur",
              date: str = "award_date") -> list[Column]:
    """Conditions of a request; each is a plain filter Catalyst can push."""
    out = []
    if request.branch:
        out.append(F.array_contains(branch_list(F.col("branch"), F.col("branch_candidates"), False), request.branch))
    for name in ("region", "province", "municipality", "segment", "change_status"):
        wanted = getattr(request, name)
        if wanted:
            out.append(F.col(name) == wanted)
    amount = F.coalesce(F.col(value), F.lit(0.0))
    if request.value_min:
        out.append(amount >= request.value_min)
    if request.value_max:
        out.append(amount <= request.value_max)
    if request.date_from:
        out.append(F.col(date) >= F.lit(request.date_from).cast("date"))
    if request.date_to:
        out.append(F.col(date) <= F.lit(request.date_to).cast("date"))
    words = request.text.strip().lower()
    if words:
        blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_columns]))
        out.append(F.contains(blob, F.lit(words)))
    return out


def matches(df: DataFrame, request: SearchRequest, **options) -> DataFrame:
    for condition in predicate(request, **options):
        df = df.filter(condition)
    return df


def search(df: DataFrame, request: SearchRequest, order: Sequence[Column], limit: int = 300, **options) -> DataFrame:
    """First ``limit`` matches in the table's order."""
    return matches(df, request, **options).orderBy(*order).limit(limit)


def facets(df: DataFrame, request: SearchRequest = SearchRequest(), territory: DataFrame | None = None) -> DataFrame:
    """Selectable values per facet under the chosen parents, as (facet, value) rows.

    With a branch chosen the geographic facets come from the branch territory, or from the
    records if that branch has none.  Every source is read once: rows are expanded to the
    facets they contribute to and made distinct.  Sorted by facet and value.
    """
    def same(name: str) -> Column:
        wanted = getattr(request, name)
        return F.lit(True) if not wanted else F.col(name) == wanted

    def entry(name: str, condition: Column) -> Column:
        v = blank_to_null(F.col(name))
        return F.when(condition & v.isNotNull(), F.struct(F.lit(name).alias("facet"), v.alias("value")))

    names = branch_list(F.col("branch"), F.col("branch_candidates"), False)
    listed = F.transform(names, lambda b: F.struct(F.lit("branch").alias("facet"), b.alias("value")))
    geo = [entry("region", F.lit(True)), entry("province", same("region")),
           entry("municipality", same("region") & same("province"))]
    own = [entry("segment", F.lit(True))]
    entries = lambda es: F.array_compact(F.array(*es))
    parts = df.select(F.inline(F.concat(entries(own + geo), listed)))
    if request.branch and territory is not None:
        # an empty region marks that the branch has a territory at all; values are few once distinct
        mark = F.struct(F.lit("region").alias("facet"), F.lit("").alias("value"))
        chosen = territory.filter(F.col("branch") == request.branch).select(F.inline(F.concat(entries(geo), F.array(mark))))
        tagged = parts.withColumn("source", F.lit(1)).unionByName(chosen.withColumn("source", F.lit(0))).distinct()
        of_place = F.col("facet").isin("region", "province", "municipality")
        best = F.min("source").over(Window.partitionBy(of_place))
        parts = tagged.withColumn("_best", best).filter((~of_place | (F.col("source") == F.col("_best"))) & (F.col("value") != "")).drop("source", "_best")
    return parts.distinct().orderBy("facet", "value")
