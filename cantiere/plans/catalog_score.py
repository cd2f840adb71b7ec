"""Catalogue: scores, bands, shortlist, diagnostics and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions import text as T
from cantiere.functions import values as V
from cantiere.operators import report, topk
from cantiere.operators.classify import with_segments
from cantiere.plans import bindings as B
from cantiere.plans import sqltext as S

SHORT = ["cup", "title", "category", "region", "province", "municipality", "value_eur", "client", "source_url"]


def operational_shortlist(spark, sf) -> DataFrame:
    """Flagship: segments, operational score, macro projects dropped, score at least 45."""
    rows = B.shortlisted(spark, sf)
    band, _ = R.labelled_bands(B.BANDS, B.LOWEST_BAND)(F.col("value_eur"))
    return rows.select("operational_score", "primary_segment", V.pipe_text(F.col("segment_tags")).alias("segment_tags"),
                       "year", band.alias("value_band"), *SHORT)


_SHORT_SQL = f"""SELECT operational_score, primary_segment, segment_tags, year, {S.BAND} AS value_band, {', '.join(SHORT)}
FROM shortlist"""


def operational_dashboard(spark, sf) -> DataFrame:
    return topk.top(operational_shortlist(spark, sf), topk.by_score(score="operational_score"), 250)


def segments_reduced(spark, sf) -> DataFrame:
    text = ["title", "category", "client", "municipality", "province", "region"]
    bound = with_segments(B.projects(spark, sf), text, "category", B.SEGMENT_TERMS, B.SEGMENT_WEIGHTS, reduced=True)
    bound = bound.withColumn("bound_tags", F.col("segment_tags"))
    preset = with_segments(bound, text, "category", P.REDUCED_SEGMENT_TERMS, P.REDUCED_SEGMENT_WEIGHTS, reduced=True)
    return preset.select("cup", V.pipe_text(F.col("bound_tags")).alias("segment_tags"), V.pipe_text(F.col("segment_tags")).alias("preset_tags"))


def operational_score_reduced(spark, sf) -> DataFrame:
    rows = B.scored(B.segmented(B.projects(spark, sf)), full=False)
    live = D.is_live(F.col("status"), D.phase(F.col("status")))
    return topk.shortlist(rows.filter(live), B.macro_project()).select("cup", "operational_score", "primary_segment")


def commercial_score_v1(spark, sf) -> DataFrame:
    p = B.projects(spark, sf).withColumns({
        "phase": D.phase(F.col("status")),
        "intervention": F.when(F.col("year") >= 2000, "nuova costruzione"),
        "contractor": F.when(F.col("status") == "CHIUSO", F.col("client")),
        "rup": F.when(F.col("value_eur") > 250_000, F.lit("Mario Rossi")),
        "description": F.when(F.col("category") != "FURNITURE", F.concat(
            F.lit("Lavori Pubblici "), F.when(F.col("region") == "ASIA", "con contributo").otherwise(""))),
    })
    text = T.lower_text(*[F.col(c) for c in ("title", "description", "category", "phase", "status", "intervention")])
    return p.select("cup", D.commercial_score_v1(
        text, F.col("category"), F.col("value_eur"), F.col("phase"), F.col("intervention"), F.col("client"), F.col("contractor"),
        F.col("rup"), F.col("cup"), F.col("region"), F.col("province"), F.col("municipality"), F.col("description"),
        B.COMMERCIAL_STEPS, B.HIGH_CATEGORIES).alias("commercial_score"))


V1_SQL = f"""WITH {S.PROJECTS}
SELECT cup, greatest(0, least(100, CASE WHEN category IN ('BUILDING','MACHINERY','HOUSEHOLD') THEN 25 ELSE 0 END
  + CASE WHEN value_eur >= 400000 THEN 35 WHEN value_eur >= 300000 THEN 30 WHEN value_eur >= 200000 THEN 22
         WHEN value_eur >= 100000 THEN 12 WHEN value_eur >= 50000 THEN 6 ELSE -20 END
  + CASE WHEN status = 'CHIUSO' THEN 0 ELSE 20 END + CASE WHEN year >= 2000 THEN 10 ELSE 0 END + 8
  + CASE WHEN status = 'CHIUSO' THEN 10 ELSE 0 END + CASE WHEN value_eur > 250000 THEN 8 ELSE 0 END + 5 + 3 + 3 + 4
  + CASE WHEN category <> 'FURNITURE' THEN 10 ELSE -10 END
  + CASE WHEN category <> 'FURNITURE' AND region = 'ASIA' THEN -20 ELSE 0 END)) AS commercial_score FROM projects"""


def commercial_score_v2(spark, sf) -> DataFrame:
    return B.with_commercial_score(B.projects(spark, sf)).select("cup", "phase", "commercial_score")


def value_bands(spark, sf) -> DataFrame:
    p = B.with_commercial_score(B.projects(spark, sf))
    scaled = F.col("value_eur") * 1000
    wide, _ = R.labelled_bands(P.WIDE_BANDS, P.LOWEST_BAND)(scaled)
    narrow, _ = R.labelled_bands(P.NARROW_BANDS, P.LOWEST_BAND)(scaled)
    return p.select("cup", "value_band", "band_order", wide.alias("wide_band"), narrow.alias("narrow_band"))


BANDS_SQL = f"""WITH {S.PROJECTS}
SELECT cup, {S.BAND} AS value_band,
  {S.case_steps('value_eur', [(400000, 1), (300000, 2), (200000, 3), (100000, 4), (50000, 5), (20000, 6), (10000, 7)], 8)} AS band_order,
  CASE WHEN value_eur * 1000 >= 100000000 THEN '100M - 500M' WHEN value_eur * 1000 >= 50000000 THEN '50M - 100M'
       WHEN value_eur * 1000 >= 20000000 THEN '20M - 50M' WHEN value_eur * 1000 >= 5000000 THEN '5M - 20M' ELSE '1M - 5M' END AS wide_band,
  CASE WHEN value_eur * 1000 >= 100000000 THEN '>= 100M' WHEN value_eur * 1000 >= 50000000 THEN '50M - 100M'
       WHEN value_eur * 1000 >= 20000000 THEN '20M - 50M' WHEN value_eur * 1000 >= 5000000 THEN '5M - 20M' ELSE '1M - 5M' END AS narrow_band
FROM projects"""


def award_weight_ratio(spark, sf) -> DataFrame:
    value = B.table(spark, sf, "orders").select(B.cup_of("o_orderkey").alias("cup"), F.col("o_totalprice").alias("value_eur"))
    rows = B.awards(spark, sf, with_contractor=False).join(value, "cup")
    check = D.ratio_check(F.col("award_amount_eur"), F.col("value_eur"), B.RATIO_WINDOW)
    return rows.groupBy(D.award_weight(F.col("award_amount_eur"), F.col("value_eur")).alias("award_weight"),
                        check["status"].alias("ratio_status"), check["note"].alias("ratio_note")).agg(
        F.count(F.lit(1)).alias("n_rows"), V.exact_sum(F.col("award_amount_eur")).alias("total_eur"))


RATIO_SQL = """WITH r AS (SELECT l_extendedprice AS a, l_extendedprice / o_totalprice AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN q >= 0.5 THEN 'Appalto principale / molto rilevante' WHEN q >= 0.1 THEN 'Lotto rilevante'
            WHEN q >= 0.01 THEN 'Lotto / servizio significativo' ELSE 'Affidamento minore' END AS award_weight,
  CASE WHEN q > 1.5 OR q < 0.05 THEN 'anomalia' ELSE 'ok' END AS ratio_status,
  CASE WHEN q > 1.5 THEN 'Importo aggiudicazione superiore al 150% del valore progetto'
       WHEN q < 0.05 THEN 'Importo aggiudicazione inferiore allo 0,5% del valore progetto'
       ELSE 'Rapporto importo/valore coerente' END AS ratio_note,
  count(*) AS n_rows, CAST(sum(CAST(a AS DECIMAL(18,2))) AS DOUBLE) AS total_eur FROM r GROUP BY 1, 2, 3"""


def diagnostics_grouping_sets(spark, sf) -> DataFrame:
    return report.diagnostics(B.with_commercial_score(B.projects(spark, sf)), B.BAND_ORDER)


def _diag(dim: str, order: str = "NULL") -> str:
    return (f"SELECT '{dim}' AS dimension, {dim} AS key, {order} AS key_order, count(*) AS count, "
            f"CAST(sum(CAST(value_eur AS DECIMAL(18,2))) AS DOUBLE) AS total_value_eur, "
            f"CAST(sum(commercial_score) AS DOUBLE) / count(*) AS avg_score FROM commercial GROUP BY {dim}")


_BAND_ORDER = S.case_steps("min(value_eur)", [(400000, 1), (300000, 2), (200000, 3), (100000, 4), (50000, 5), (20000, 6), (10000, 7)], 8)
DIAGNOSTICS_SQL = (f"WITH {S.PROJECTS},\n{S.COMMERCIAL}\n" + _diag("category") + " UNION ALL " + _diag("value_band", _BAND_ORDER)
                   + " UNION ALL " + _diag("region"))


def segment_rollup(spark, sf) -> DataFrame:
    return report.segment_rollup(B.shortlisted(spark, sf))


def national_view(spark, sf) -> DataFrame:
    """Shortlist under published names, from the text form a delimited file would have."""
    rows = operational_shortlist(spark, sf).withColumn("value_eur", F.translate(F.format_number("value_eur", 2), ",.", ".,"))
    return topk.national_view(rows)


_TOP_COLUMNS = ["cup", "title", "category", "region", "value_eur", "client", "phase", "status", "commercial_score"]
_COMMERCIAL = f"WITH {S.PROJECTS},\n{S.COMMERCIAL}\n"
_BEST = "commercial_score DESC, value_eur DESC, cup"


def _commercial(spark, sf) -> DataFrame:
    return B.with_commercial_score(B.projects(spark, sf))


def top_per_category(spark, sf) -> DataFrame:
    return topk.top_per_category(_commercial(spark, sf)).select(*_TOP_COLUMNS, "rank")


def top_mid_market(spark, sf) -> DataFrame:
    return topk.mid_market(_commercial(spark, sf), B.MID_MARKET).select(*_TOP_COLUMNS)


def top_local_public(spark, sf) -> DataFrame:
    return topk.local_public(_commercial(spark, sf)).select(*_TOP_COLUMNS)


def top_macro(spark, sf) -> DataFrame:
    return topk.macro(_commercial(spark, sf), B.macro_project()).select(*_TOP_COLUMNS)


_T = ", ".join(_TOP_COLUMNS)
ENTRIES = {
    "operational_shortlist": (operational_shortlist, f"WITH {S.SHORTLISTED}\n{_SHORT_SQL}"),
    "operational_dashboard": (operational_dashboard,
        f"WITH {S.SHORTLISTED}\n{_SHORT_SQL} ORDER BY operational_score DESC, value_eur DESC, cup LIMIT 250"),
    "segments_reduced": (segments_reduced, f"""WITH {S.PROJECTS},\n{S.SEGMENTED}
SELECT cup, segment_tags, CASE WHEN contains(lower(title || ' ' || category || ' ' || client), 'verde') THEN 'Verde' ELSE 'Altro' END AS preset_tags
FROM segmented"""),
    "operational_score_reduced": (operational_score_reduced, f"""WITH {S.PROJECTS},\n{S.SEGMENTED},\n{S.SCORED}
SELECT cup, reduced_score AS operational_score, primary_segment FROM scored
WHERE NOT {S.MACRO} AND reduced_score >= 45 AND (status IS NULL OR status <> 'CHIUSO')"""),
    "commercial_score_v1": (commercial_score_v1, V1_SQL),
    "commercial_score_v2": (commercial_score_v2, _COMMERCIAL + "SELECT cup, phase, commercial_score FROM commercial"),
    "value_bands": (value_bands, BANDS_SQL),
    "award_weight_ratio": (award_weight_ratio, RATIO_SQL),
    "diagnostics_grouping_sets": (diagnostics_grouping_sets, DIAGNOSTICS_SQL),
    "segment_rollup": (segment_rollup, f"""WITH {S.SHORTLISTED}
SELECT primary_segment, count(*) AS count, CAST(sum(CAST(value_eur AS DECIMAL(18,2))) AS DOUBLE) AS total_value_eur,
  CAST(sum(operational_score) AS DOUBLE) / count(*) AS avg_score FROM shortlist GROUP BY 1"""),
    "national_view": (national_view, f"""WITH {S.SHORTLISTED}
SELECT operational_score AS score, primary_segment AS segment, title, category, region, province, municipality, value_eur, client, cup, source_url
FROM shortlist"""),
    "top_per_category": (top_per_category, _COMMERCIAL + f"""SELECT {_T},
  row_number() OVER (PARTITION BY category ORDER BY {_BEST}) AS rank FROM commercial QUALIFY rank <= 20"""),
    "top_mid_market": (top_mid_market, _COMMERCIAL + f"SELECT {_T} FROM commercial WHERE value_eur BETWEEN 100000 AND 300000 ORDER BY {_BEST} LIMIT 1000"),
    "top_local_public": (top_local_public, _COMMERCIAL + f"""SELECT {_T} FROM commercial
WHERE client LIKE 'COMUNE%' OR client LIKE 'REGIONE%' OR client LIKE 'PROVINCIA%' ORDER BY {_BEST} LIMIT 1000"""),
    "top_macro": (top_macro, _COMMERCIAL + f"SELECT {_T} FROM commercial WHERE {S.MACRO} ORDER BY value_eur DESC, commercial_score DESC, cup LIMIT 1000"),
}
