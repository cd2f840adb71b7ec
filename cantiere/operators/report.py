"""Roll-ups: diagnostics, KPIs, data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions.text import blank_to_null
from cantiere.functions.values import exact_sum, has_text, percentage
from cantiere.operators.dedupe import top_per_key


def _average(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total, n.cast("double")), F.lit(0.0))


def diagnostics(df: DataFrame, band_order: Mapping[str, int], value: str = "value_eur", score: str = "commercial_score") -> DataFrame:
    """Counts, sums and average score by category, value band and region in one pass.

    Categories and regions by count, then value, bands in their own order; the key decides ties.
    """
    nd = lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit("ND")).alias(c)
    dims = ["category", "value_band", "region"]
    rows = df.select(nd("category"), "value_band", nd("region"), F.col(value).alias("_v"), F.col(score).alias("_s"))
    out = rows.groupingSets([["category"], ["value_band"], ["region"]], *dims).agg(
        F.grouping_id(*dims).alias("_g"),
        F.count(F.lit(1)).alias("count"),
        exact_sum(F.coalesce(F.col("_v"), F.lit(0.0))).alias("total_value_eur"),
        F.sum(F.coalesce(F.col("_s"), F.lit(0))).alias("_score"),
    )
    return out.select(
        R.lookup(F.col("_g"), {0b011: "category", 0b101: "value_band", 0b110: "region"}).alias("dimension"),
        F.coalesce(*dims).alias("key"),
        F.when(F.col("_g") == 0b101, R.lookup(F.col("value_band"), dict(band_order), 99)).alias("key_order"),
        "count", "total_value_eur", _average(F.col("_score"), F.col("count")).alias("avg_score"),
    ).orderBy("dimension", F.asc_nulls_last("key_order"), F.desc("count"), F.desc("total_value_eur"), "key")


def segment_rollup(df: DataFrame, segment: str = "primary_segment", value: str = "value_eur", score: str = "operational_score") -> DataFrame:
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("count"),
        exact_sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total_value_eur"),
        F.avg(F.col(score)).alias("avg_score"),
    ).orderBy(F.desc("count"), segment)


# -- home KPIs ---------------------------------------------------------------


def kpis(df: DataFrame, by: Sequence[str], value: str = "value_eur", contractor: str = "has_contractor") -> DataFrame:
    """Count, contractor coverage, sum and mean per group (no group: one national row)."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col(contractor)).alias("with_contractor"),
        exact_sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total_value_eur"),
    )
    return out.select(
        *by, "count", "with_contractor", (F.col("count") - F.col("with_contractor")).alias("without_contractor"),
        percentage(F.col("with_contractor"), F.col("count")).alias("coverage_pct"),
        F.coalesce("total_value_eur", F.lit(0.0)).alias("total_value_eur"),
        _average(F.col("total_value_eur"), F.col("count")).alias("avg_value_eur"),
    )


def kpi_sums(df: DataFrame, by: Sequence[str], value: str = "value_eur", contractor: str = "has_contractor", sign: Column | None = None,
             flags: Sequence[str] = ()) -> DataFrame:
    """What :func:`kpis` is made of, and the number of rows with each flag; with ``sign`` (1 or -1) as a change of it."""
    sign = F.lit(1) if sign is None else sign
    number = lambda flag: F.sum(F.when(F.col(flag), sign).otherwise(0)).cast("long").alias(flag)
    return df.groupBy(*by).agg(
        F.sum(sign).cast("long").alias("count"), number(contractor).alias("with_contractor"),
        F.sum(F.coalesce(F.col(value), F.lit(0.0)).cast("decimal(18,2)") * sign.cast("decimal(1,0)")).cast("decimal(38,2)").alias("total_value_eur"),
        *[number(f) for f in flags],
    )


def add_sums(stored: DataFrame, change: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored sums after a change; groups without rows go."""
    both = stored.unionByName(change)
    sums = [F.sum(c).cast(stored.schema[c].dataType).alias(c) for c in stored.columns if c not in by]
    return both.groupBy(*by).agg(*sums).filter(F.col("count") > 0)


def kpis_of_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """The columns of :func:`kpis`, from sums."""
    total = F.col("total_value_eur").cast("double")
    return sums.select(
        *by, "count", "with_contractor", (F.col("count") - F.col("with_contractor")).alias("without_contractor"),
        percentage(F.col("with_contractor"), F.col("count")).alias("coverage_pct"),
        total.alias("total_value_eur"), _average(total, F.col("count")).alias("avg_value_eur"),
    )


def area_of(region: Column, areas: Mapping[str, str] = P.AREA_BY_REGION) -> Column:
    table = F.create_map(*[F.lit(x) for pair in areas.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(region))), F.lit(P.NO_AREA))


def area_kpis(df: DataFrame, areas: Mapping[str, str] = P.AREA_BY_REGION, order: Sequence[str] = P.AREA_ORDER,
              include_unclassified: bool = False, **columns: str) -> DataFrame:
    """KPIs by macro area in fixed order."""
    out = kpis(df.withColumn("area", area_of(F.col("region"), areas)), ["area"], **columns)
    rank = R.lookup(F.col("area"), {a: i + 1 for i, a in enumerate(order)}, 99)
    out = out.withColumn("area_order", rank)
    return out if include_unclassified else out.filter(F.col("area_order") < 99)


def frequencies(df: DataFrame, column: str, missing: str, top: int | None = None) -> DataFrame:
    name = F.coalesce(blank_to_null(F.col(column)), F.lit(missing)).alias("name")
    out = df.groupBy(name).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name")
    return out if top is None else out.limit(top)


def branch_rankings(stats: DataFrame, top: int = 12, min_count: int = 1000) -> DataFrame:
    """Best branches by count, by value and by coverage (large branches only), tagged."""
    def best(df: DataFrame, column: str, tag: str) -> DataFrame:
        head = df.orderBy(F.desc(column), "branch").limit(top)
        return head.select(F.lit(tag).alias("ranking"), "*")

    return (
        best(stats, "count", "count")
        .unionByName(best(stats, "total_value_eur", "value"))
        .unionByName(best(stats.filter(F.col("count") >= min_count), "coverage_pct", "coverage"))
    )


# -- data quality ------------------------------------------------------------


def issue_flags(cup: Column, branch: Column, region: Column, province: Column, municipality: Column, value: Column,
                source_url: Column) -> dict[str, Column]:
    """Condition per issue, in report order."""
    b = F.upper(F.trim(branch))
    missing = lambda c: ~has_text(c)
    conditions = (
        missing(cup),
        F.coalesce(b.isin(P.UNASSIGNED, "NON_ASSEGNATA"), F.lit(False)),
        F.coalesce(b == P.AMBIGUOUS, F.lit(False)),
        missing(region), missing(province), missing(municipality),
        ~F.coalesce(value > 0, F.lit(False)),
        missing(source_url),
    )
    return dict(zip(P.QUALITY_ISSUES, conditions))


def with_issues(df: DataFrame, **columns: str) -> DataFrame:
    """Add the array of issue names of every record."""
    col = lambda name: F.col(columns.get(name, name))
    conditions = issue_flags(col("cup"), col("branch"), col("region"), col("province"), col("municipality"),
                             col("value_eur"), col("source_url"))
    return df.withColumn("issues", R.flags(conditions))


def quality_counters(df: DataFrame, by: Sequence[str] = (), contractor: str = "has_contractor") -> DataFrame:
    """Records, every issue and contractor coverage, overall or per group."""
    counts = [F.count_if(F.array_contains("issues", i)).alias(i) for i in P.QUALITY_ISSUES]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), *counts,
                              F.count_if(F.col(contractor)).alias("with_contractor"))
    return out.withColumn("contractor_coverage_pct", percentage(F.col("with_contractor"), F.col("records")))


def branch_quality_order() -> list[Column]:
    weight = sum((F.col(c) for c in ("ambigua", "missing_province", "missing_municipality", "missing_source_url")),
                 F.col("non_assegnata"))
    return [F.desc(weight), F.desc("records"), F.asc("branch")]


def issue_table(counters: DataFrame) -> DataFrame:
    """One row per issue with share and severity."""
    tall = counters.unpivot(["records"], list(P.QUALITY_ISSUES), "issue", "count")
    severity = F.when(F.col("count") == 0, "ok").when(F.col("issue").isin(*P.INFO_ISSUES), "info").otherwise("warning")
    return tall.select("issue", "count", percentage(F.col("count"), F.col("records")).alias("pct"), severity.alias("severity"))


def issue_samples(df: DataFrame, order: Sequence[Column], columns: Sequence[str], per_issue: int = 10,
                  title_length: int = 180) -> DataFrame:
    """First records of every issue, in scan order; the title is cut for display."""
    rows = df.withColumn("issue", F.explode("issues"))
    best = top_per_key(rows, ["issue"], order, per_issue, rank="sample_no")
    shown = [F.substring("title", 1, title_length).alias("title") if c == "title" else F.col(c) for c in columns]
    return best.select("issue", "sample_no", *shown)


def size_status(mb: Column) -> Column:
    return R.steps(mb, ((P.SHARD_CRITICAL_MB, "critical"), (P.SHARD_WARN_MB, "warning")), "ok")
