"""Catalogue: deduplication, code linkage, awards, evidence, master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantiere.functions import values as V
from cantiere.operators import awards as A
from cantiere.operators import dedupe, link
from cantiere.plans import bindings as B
from cantiere.plans import sqltext as S

# -- one row per key ---------------------------------------------------------

_LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def dedupe_first_seen(spark, sf) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    out = dedupe.first_per_key(li, ["l_orderkey", "l_linenumber"], _LINE)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def dedupe_max_value(spark, sf) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    key = F.coalesce(F.nullif(F.col("l_orderkey").cast("string"), F.lit("")), F.col("l_returnflag"))
    out = dedupe.max_value_per_key(li, key, F.col("l_extendedprice"), [F.asc(c) for c in ["l_linenumber", *_LINE]])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def _candidates(spark, sf) -> DataFrame:
    """Target rows from two reports: the full score, and the reduced one with padded lower-case codes."""
    base = B.segmented(B.projects(spark, sf))
    cols = ["cup", "title", "value_eur", "operational_score", "primary_segment"]
    full = B.scored(base).select(*cols, F.lit(0).alias("report"))
    reduced = B.scored(base, full=False).withColumns({
        "cup": F.concat(F.lit(" "), F.lower("cup")), "title": F.lit(None).cast("string"),
    }).select(*cols, F.lit(1).alias("report"))
    return full.unionByName(reduced)


def best_target_per_project(spark, sf) -> DataFrame:
    best = dedupe.best_target(_candidates(spark, sf), position=[F.asc("report")])
    return best.orderBy(F.desc("operational_score"), F.desc("value_eur"), "cup")


TARGET_SQL = f"""WITH {S.PROJECTS},\n{S.SEGMENTED},\n{S.SCORED},
c AS (SELECT cup, title, value_eur, operational_score, primary_segment, 0 AS report FROM scored
      UNION ALL SELECT cup, NULL, value_eur, reduced_score, primary_segment, 1 FROM scored)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cup ORDER BY operational_score DESC, value_eur DESC, title IS NULL, report) = 1"""


def best_award_per_tender(spark, sf) -> DataFrame:
    rows = B.awards(spark, sf, with_contractor=False)
    text_date = F.when(F.col("contractor_role") == "N", F.date_format("award_date", "yyyy-MM-dd")).otherwise(
        F.date_format("award_date", "dd/MM/yyyy"))
    rows = rows.withColumns({"day": F.col("award_date"), "award_date": text_date})
    best = link.best_outcome(rows, [F.desc("award_amount_eur"), F.asc("cup"), F.asc("award_result_code"), F.asc("day"),
                                    F.asc("contractor_tax_code"), F.asc("contractor_role"), F.asc("quantity")])
    return best.select("cig", "cup", "award_amount_eur", F.col("day").alias("award_date"), "award_result", "award_result_code", "preference")


_PREFERENCE = """CASE award_result WHEN 'AGGIUDICATA' THEN 100 ELSE 0 END + CASE award_result_code WHEN '1' THEN 100 ELSE 0 END
  + CASE WHEN award_amount_eur > 0 THEN 30 ELSE 0 END + year(award_date)"""
_BEST_AWARD = f"""best AS (SELECT *, {_PREFERENCE} AS preference FROM awards
  QUALIFY row_number() OVER (PARTITION BY cig ORDER BY preference DESC, award_amount_eur DESC, cup, award_result_code, award_date,
     contractor_tax_code, contractor_role, quantity) = 1)"""


def _best(spark, sf) -> DataFrame:
    rows = B.awards(spark, sf, with_contractor=False)
    return link.best_outcome(rows, [F.desc("award_amount_eur"), F.asc("cup"), F.asc("award_result_code"), F.asc("award_date"),
                                    F.asc("contractor_tax_code"), F.asc("contractor_role"), F.asc("quantity")])


def _metadata(spark, sf) -> DataFrame:
    """Metadata rows of two shards: a thin one first, then the complete projects."""
    p = B.segmented(B.projects(spark, sf))
    thin = p.select("cup", F.when(F.col("status") == "ATTIVO", F.col("title")).alias("title"),
                    F.when(F.col("year") > 1998, F.col("client")).alias("client"), "region", "value_eur").withColumn("_pos", F.lit(0))
    full = p.select("cup", "title", F.when(F.col("region") != "ASIA", F.col("client")).alias("client"), "primary_segment", "region",
                    "province", F.when(F.col("category") != "FURNITURE", F.col("municipality")).alias("municipality"),
                    "value_eur", "source_url").withColumn("_pos", F.lit(1))
    return link.metadata(thin.unionByName(full, allowMissingColumns=True))


def richest_metadata(spark, sf) -> DataFrame:
    best = link.richest_metadata(_metadata(spark, sf), [F.asc("_pos")])
    return best.select("cup", "title", "client", "municipality", "value_eur", "completeness")


_META = f"""meta AS (SELECT cup, title, CASE WHEN region <> 'ASIA' THEN client END AS client,
   CASE WHEN category <> 'FURNITURE' THEN municipality END AS municipality, CAST(value_eur AS VARCHAR) AS value_eur,
   8 + CASE WHEN region <> 'ASIA' THEN 1 ELSE 0 END + CASE WHEN category <> 'FURNITURE' THEN 1 ELSE 0 END AS completeness
   FROM projects)"""


def representative_project(spark, sf) -> DataFrame:
    links = B.links(spark, sf)
    best = link.richest_metadata(_metadata(spark, sf), [F.asc("_pos")])
    return link.representative_project(links, best)


_REPRESENTATIVE = """representative AS (SELECT cig, cup FROM links JOIN meta USING (cup)
  QUALIFY row_number() OVER (PARTITION BY cig ORDER BY completeness DESC, cup) = 1)"""


def identity_key(spark, sf) -> DataFrame:
    p = B.projects(spark, sf)
    cup = F.when(F.col("status") == "CHIUSO", F.lower("cup"))
    cig = F.when(F.col("year") < 1998, F.concat(F.lit(" t"), F.substring("cup", 2, 9)))
    rid = F.when(F.col("region") == "ASIA", F.concat(F.lit("r-"), "cup"))
    value = F.col("value_eur").cast("decimal(18,2)")
    key = dedupe.identity_key(cup, cig, rid, F.col("title"), F.col("client"), F.col("municipality"), F.col("province"), value)
    simple = dedupe.row_key(cup, cig, F.col("title"), F.col("municipality"))
    return p.select("cup", key.alias("identity_key"), simple.alias("row_key"))


IDENTITY_SQL = f"""WITH {S.PROJECTS}
SELECT cup, CASE WHEN status = 'CHIUSO' THEN 'CUP::' || cup WHEN year < 1998 THEN 'CIG::T' || substring(cup, 2, 9)
    WHEN region = 'ASIA' THEN 'ID::R-' || cup
    ELSE 'HASH::' || sha1(upper(title) || '|' || upper(client) || '|' || municipality || '|' || province || '|'
                          || CAST(CAST(value_eur AS DECIMAL(18,2)) AS VARCHAR)) END AS identity_key,
  CASE WHEN status = 'CHIUSO' AND year < 1998 THEN 'CUP_CIG::' || cup || '::T' || substring(cup, 2, 9)
       WHEN status = 'CHIUSO' THEN 'CUP::' || cup ELSE 'TITLE::' || upper(title) || '::' || municipality END AS row_key FROM projects"""


def duplicate_codes(spark, sf) -> DataFrame:
    return dedupe.duplicate_codes(B.links(spark, sf), "cup")


# -- linkage -----------------------------------------------------------------


def _targets(spark, sf) -> DataFrame:
    """Target codes as a landed one-column table: several joins read it, the scores are computed once."""
    return B.land(B.shortlisted(spark, sf).select("cup"), "targets")


def link_semi_join(spark, sf) -> DataFrame:
    raw = B.links(spark, sf).select(F.concat(F.lit(" "), F.lower("cup")).alias("cup"), F.lower("cig").alias("cig"))
    return link.link_projects(raw, _targets(spark, sf))


def link_semi_join_raw(spark, sf) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    cup = F.when(F.col("l_returnflag") == "R", F.lower(B.cup_of("l_orderkey"))).otherwise(B.cup_of("l_orderkey"))
    cig = F.when(F.col("l_linestatus") == "F", B.cig_of("l_partkey"))
    rows = li.select(cup.alias("cup"), cig.alias("cig"), F.col("l_returnflag").alias("dataset"))
    return link.link_projects_raw(rows, _targets(spark, sf), source="dataset")


def link_sets(spark, sf) -> DataFrame:
    """Both directions of the link sets as text lists."""
    links = B.links(spark, sf)
    a = link.list_text(link.tender_sets(links), "cigs").select(
        F.lit("project").alias("side"), F.col("cup").alias("code"), "part", F.col("cigs").alias("codes"), F.col("cig_count").alias("n_codes"))
    b = link.list_text(link.project_sets(links), "cups").select(
        F.lit("tender").alias("side"), F.col("cig").alias("code"), "part", F.col("cups").alias("codes"), F.col("cup_count").alias("n_codes"))
    return a.unionByName(b)


LINK_SETS_SQL = f"""WITH {S.LINKS}
SELECT 'project' AS side, cup AS code, 0 AS part, string_agg(DISTINCT cig, ' | ' ORDER BY cig) AS codes, count(DISTINCT cig) AS n_codes
FROM links GROUP BY cup
UNION ALL SELECT 'tender', cig, 0, string_agg(DISTINCT cup, ' | ' ORDER BY cup), count(DISTINCT cup) FROM links GROUP BY cig"""


def link_coverage(spark, sf) -> DataFrame:
    targets, links = _targets(spark, sf), B.links(spark, sf)
    return link.coverage(targets, links, link.link_projects(links, targets))


COVERAGE_SQL = f"""WITH {S.SHORTLISTED},\n{S.LINKS},
m AS (SELECT * FROM links WHERE cup IN (SELECT cup FROM shortlist)),
n AS (SELECT (SELECT count(DISTINCT cup) FROM shortlist) AS target_cups, (SELECT count(*) FROM links) AS rows_scanned,
  (SELECT count(*) FROM m) AS match_rows, (SELECT count(DISTINCT cup) FROM m) AS matched_target_cups,
  (SELECT count(DISTINCT cig) FROM m) AS matched_unique_cigs)
SELECT *, target_cups - matched_target_cups AS unmatched_target_cups,
  100.0 * matched_target_cups / target_cups AS coverage_target_cups_pct,
  CAST(match_rows AS DOUBLE) / matched_target_cups AS avg_cig_per_matched_cup FROM n"""


def code_set_ops(spark, sf) -> DataFrame:
    """Union of two target lists, its staleness check and the targets without link."""
    targets = _targets(spark, sf)
    old = B.projects(spark, sf).filter(F.col("decided_on") < F.lit("1996-01-01").cast("date")).select(F.lower("cup").alias("cup"))
    both, check = link.union_targets(old, targets)
    missing = link.missing_targets(both, link.link_projects(B.links(spark, sf), both))
    stale = check.select(F.lit("stale").alias("kind"), F.concat_ws("/", "csv_cups", "shard_cups", "stale").alias("cup"))
    return (
        both.select(F.lit("target").alias("kind"), "cup")
        .unionByName(missing.select(F.lit("missing").alias("kind"), "cup")).unionByName(stale)
    )


SETS_SQL = f"""WITH {S.SHORTLISTED},\n{S.LINKS},
old AS (SELECT cup FROM projects WHERE decided_on < DATE '1996-01-01'),
u AS (SELECT cup FROM old UNION SELECT cup FROM shortlist)
SELECT 'target' AS kind, cup FROM u UNION ALL SELECT 'missing', cup FROM u WHERE cup NOT IN (SELECT cup FROM links)
UNION ALL SELECT 'stale', (SELECT count(*) FROM old) || '/' || (SELECT count(*) FROM shortlist) || '/' ||
  CASE WHEN (SELECT count(*) FROM old) < 0.1 * (SELECT count(*) FROM shortlist) THEN 'true' ELSE 'false' END"""


def tender_contractors(spark, sf) -> DataFrame:
    """Contractor rows of target tenders with the tender's representative project."""
    targets = link.representative_project(
        link.link_projects(B.links(spark, sf), _targets(spark, sf)),
        link.richest_metadata(_metadata(spark, sf), [F.asc("_pos")]))
    raw = B.contractors(spark, sf).toDF("Codice CIG", "Denominazione OE", "codice_fiscale", "P.IVA", "Ruolo")
    rows = link.rename_headers(raw, {"cig": link.P.TENDER_CODE_HEADERS, **link.P.CONTRACTOR_HEADERS}, required=["cig"])
    return link.contractor_matches(rows, targets)


TENDER_CONTRACTORS_SQL = f"""WITH {S.SHORTLISTED},\n{S.LINKS},\n{_META},
t AS (SELECT cig, cup FROM links JOIN meta USING (cup) WHERE cup IN (SELECT cup FROM shortlist)
      QUALIFY row_number() OVER (PARTITION BY cig ORDER BY completeness DESC, cup) = 1)
SELECT cig, t.cup, s_name AS contractor_name, CAST(s_suppkey AS VARCHAR) AS contractor_tax_code, CAST(NULL AS VARCHAR) AS contractor_vat,
  l_returnflag AS contractor_role FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN t ON t.cig = {S.CIG.format('l_partkey')}"""


def project_contractors(spark, sf) -> DataFrame:
    """Contractor lists per project and tender with the project metadata."""
    meta = B.segmented(B.projects(spark, sf)).select("cup", "title", "primary_segment", "value_eur")
    links = link.link_projects(B.links(spark, sf), _targets(spark, sf))
    profile = link.contractor_profile(B.contractors(spark, sf))
    # the text of a list is made once per tender, not per project of the tender
    texts = profile.withColumn("contractors", V.pipe_text(F.transform("contractors", A.contractor_label)))
    out = link.contractors_by_project(texts, links, meta)
    return out.select("cup", "cig", "part", "contractors", "n_contractors", "title", "primary_segment", "value_eur")


PROJECT_CONTRACTORS_SQL = f"""WITH {S.SHORTLISTED},\n{S.LINKS},
l AS (SELECT DISTINCT * FROM links WHERE cup IN (SELECT cup FROM shortlist)),
d AS (SELECT DISTINCT {S.CIG.format('l_partkey')} AS cig, s_name AS name, CAST(s_suppkey AS VARCHAR) AS tax, l_returnflag AS role
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
p AS (SELECT cig, string_agg(name || ' (' || role || ')', ' | ' ORDER BY name, tax, role) AS contractors, count(*) AS n_contractors FROM d GROUP BY cig)
SELECT l.cup, p.cig, 0 AS part, contractors, n_contractors, title, primary_segment, value_eur
FROM p LEFT JOIN l USING (cig) LEFT JOIN segmented ON segmented.cup = l.cup"""


def award_outcome_join(spark, sf) -> DataFrame:
    links = link.link_projects(B.links(spark, sf), _targets(spark, sf)).distinct()
    awarded = _best(spark, sf).filter(F.col("award_result") == "AGGIUDICATA")
    return link.with_outcome(links, awarded, ["award_amount_eur", "award_date", "award_result", "award_result_code"])


OUTCOME_SQL = f"""WITH {S.SHORTLISTED},\n{S.LINKS},\n{S.AWARDS},\n{_BEST_AWARD}
SELECT l.cup, l.cig, b.award_amount_eur, b.award_date, b.award_result, b.award_result_code
FROM (SELECT DISTINCT * FROM links WHERE cup IN (SELECT cup FROM shortlist)) l
LEFT JOIN (SELECT * FROM best WHERE award_result = 'AGGIUDICATA') b USING (cig)"""


def register_without_awards(spark, sf) -> DataFrame:
    awards = A.relevant(B.consolidated(spark, sf))
    enriched = B.projects(spark, sf).withColumns({
        "has_award": F.lit(True), "awards_count": F.lit(3), "contractors": F.lit("vecchio"), "award_date": F.lit("2000-01-01")})
    register = link.strip_awards(enriched).drop("award_date")
    union = A.raw_master(awards.select("cup", "cig", "value_eur", "award_amount_eur"), register.select("cup", "value_eur", "contractors", "awards_count"))
    return union.select("cup", "cig", "value_eur", "award_amount_eur", "has_award", V.pipe_text(F.col("sources")).alias("sources"),
                        "contractors", "awards_count")


REGISTER_SQL = f"""WITH {S.PROJECTS},\n{S.AWARDS},\n{S.CONSOLIDATED},
r AS (SELECT * FROM consolidated WHERE ratio_status = 'ok')
SELECT cup, cig, value_eur, award_amount_eur, true AS has_award, 'register | award' AS sources, CAST(NULL AS VARCHAR) AS contractors,
  CAST(NULL AS INTEGER) AS awards_count FROM r
UNION ALL SELECT cup, NULL, value_eur, NULL, false, 'register', NULL, 0 FROM projects WHERE cup NOT IN (SELECT cup FROM r)"""

# -- awards ------------------------------------------------------------------

_AWARD_COLUMNS = ["cup", "cig", "value_eur", "award_amount_eur", "award_date", "award_result", "award_share_pct", "award_weight",
                  "ratio_status", "ratio_note", "contractors", "contractor_tax_codes"]
_CONSOLIDATED = f"WITH {S.AWARDS},\n{S.CONSOLIDATED}\n"


def award_consolidation(spark, sf) -> DataFrame:
    return A.award_texts(*B.consolidated_sets(spark, sf)).select(*_AWARD_COLUMNS)


def relevant_awards(spark, sf) -> DataFrame:
    rows, members = B.consolidated_sets(spark, sf)
    return A.relevant(A.award_texts(A.relevant(rows), members), ordered=True).select(*_AWARD_COLUMNS)


def award_anomalies(spark, sf) -> DataFrame:
    rows, members = B.consolidated_sets(spark, sf)
    return A.anomalies(A.award_texts(A.anomalies(rows), members), ordered=True).select(*_AWARD_COLUMNS)


def contractor_sets(spark, sf) -> DataFrame:
    """Every distinct contractor set with its size and the number of awards that carry it."""
    rows, members = B.consolidated_sets(spark, sf)
    used = rows.groupBy("contractor_set", "contractors_count").agg(F.count(F.lit(1)).alias("n_awards"))
    return A.award_texts(used, members).select("part", "contractors", "contractor_tax_codes", "contractors_count", "n_awards")


# -- evidence ----------------------------------------------------------------


def _levels(spark, sf) -> DataFrame:
    targets = _targets(spark, sf)
    links = link.link_projects(B.links(spark, sf), targets)
    value = B.projects(spark, sf).select("cup", "value_eur")
    known, _ = link.contractor_sets(B.published_contractors(spark, sf))
    enriched = B.awards(spark, sf, with_contractor=False).select("cup", "cig", "award_result", "award_amount_eur")
    enriched = enriched.join(value, "cup").join(targets, "cup", "left_semi").join(known, "cig", "left_semi")
    c = B.consolidated(spark, sf)
    evidence = link.project_evidence(links, enriched, A.relevant(c), A.anomalies(c), B.MIN_AWARD, B.RATIO_WINDOW)
    return link.evidence_level(B.projects(spark, sf).select("cup"), evidence)


_LEVELS = f"""{S.SHORTLISTED},\n{S.LINKS},\n{S.AWARDS},\n{S.CONSOLIDATED},
e AS (SELECT a.cup, a.cig, a.award_result, a.award_amount_eur AS amount, a.award_amount_eur / s.value_eur AS q
      FROM awards a JOIN shortlist s USING (cup) WHERE a.cig IN (SELECT {S.CIG.format('l_partkey')} FROM lineitem WHERE l_suppkey % 5 <> 0)),
ev AS (SELECT cup,
    (SELECT count(DISTINCT cig) FROM links l WHERE l.cup = p.cup AND l.cup IN (SELECT cup FROM shortlist)) AS match_cig_count,
    (SELECT count(DISTINCT cig) FROM e WHERE e.cup = p.cup) AS enriched_cig_count,
    (SELECT count(*) FROM consolidated c WHERE c.cup = p.cup AND ratio_status = 'ok') AS confirmed_awards_count,
    (SELECT count(DISTINCT cig) FROM e WHERE e.cup = p.cup AND award_result = 'AGGIUDICATA' AND amount < 10000) AS small_awards_count,
    (SELECT count(DISTINCT cig) FROM (
        SELECT cup, cig FROM e WHERE award_result <> 'AGGIUDICATA' OR (amount >= 10000 AND (q < 0.05 OR q > 1.5))
        UNION ALL SELECT cup, cig FROM consolidated WHERE ratio_status <> 'ok') r WHERE r.cup = p.cup) AS review_awards_count
  FROM projects p),
levels AS (SELECT *, CASE WHEN confirmed_awards_count > 0 THEN 'confirmed' WHEN small_awards_count > 0 THEN 'small'
    WHEN review_awards_count > 0 OR enriched_cig_count > 0 THEN 'review' WHEN match_cig_count > 0 THEN 'technical' ELSE 'none' END AS evidence_level FROM ev)"""


def evidence_levels(spark, sf) -> DataFrame:
    return _levels(spark, sf)


def evidence_funnel(spark, sf) -> DataFrame:
    return link.evidence_funnel(_levels(spark, sf))


FUNNEL_SQL = f"""WITH {_LEVELS}, t AS (SELECT count(*) AS total FROM levels),
n AS (SELECT 'funnel' AS section, 'technical_match' AS name, count(*) FILTER (match_cig_count > 0) AS count FROM levels
  UNION ALL SELECT 'funnel', 'enriched', count(*) FILTER (enriched_cig_count > 0) FROM levels
  UNION ALL SELECT 'funnel', 'confirmed', count(*) FILTER (confirmed_awards_count > 0) FROM levels
  UNION ALL SELECT 'level', x.name, count(evidence_level) FROM (VALUES ('confirmed'), ('small'), ('review'), ('technical'), ('none')) x(name)
     LEFT JOIN levels ON evidence_level = x.name GROUP BY x.name)
SELECT section, name, count, 100.0 * count / total AS pct FROM n, t"""


# -- master ------------------------------------------------------------------


def _master(spark, sf) -> DataFrame:
    text = ["cup", "title", "category", "region", "province", "municipality", "client", "branch", "branch_candidates", "year", "source_url"]
    # landed tables are computed once, whatever their readers, and the shuffle files of their job are gone before the next one
    p = B.land(B.assigned(spark, sf).select(*text, "value_eur"), "projects")
    awards, members = B.consolidated_sets(spark, sf, keep=lambda tagged: B.land(tagged, "award-contractors"))
    relevant = A.relevant(awards).select("cup", "cig", "value_eur", "award_amount_eur", "award_date", "award_result", "award_share_pct", "award_weight",
                                         "ratio_note", "contractor_set", "contractors_count")
    rows = relevant.join(p.select(*text), "cup").withColumn("id", F.concat_ws("::", F.lit("AWARD"), "cup", "cig"))
    register = p.select(*text, "value_eur").withColumn("id", F.concat_ws("::", F.lit("REGISTER"), "cup"))
    raw = B.land(A.raw_master(rows, register), "raw-master")
    grouped = A.group_projects(raw, [*text, "value_eur", "id", "source"], members, keep=lambda names: B.land(names, "contractor-names"))
    quality = A.with_quality(grouped.withColumn("code_year", F.col("year")), **B.QUALITY)
    return A.nested(quality, raw, keep=lambda lists: B.land(lists, "award-lists"))


def master_projects(spark, sf) -> DataFrame:
    # only the result's columns are sorted; landed, since the sort reads its rows twice
    m = _master(spark, sf).select(
        "project_key", "part", "title", "value_eur", "branch", "has_award", "awards_count", "awards_total_eur", "last_award_date",
        "contractors_count", "contractors_summary", V.pipe_text(F.col("awards.cig")).alias("cigs"),
        "commercial_score", "data_reliability", V.pipe_text(F.col("quality_flags")).alias("quality_flags"))
    return B.land(m, "master").orderBy(*A.master_order())


_MASTER = f"""{S.PROJECTS},\n{S.BRANCH_MAP},\n{S.ASSIGNED},\n{S.AWARDS},\n{S.CONSOLIDATED},
rel AS (SELECT * FROM consolidated WHERE ratio_status = 'ok'),
tot AS (SELECT cup, count(*) AS awards_count, CAST(sum(CAST(award_amount_eur AS DECIMAL(18,2))) AS DOUBLE) AS awards_total_eur,
    max(award_date) AS last_award_date, string_agg(cig, ' | ' ORDER BY award_date, cig) AS cigs FROM rel GROUP BY cup),
lab AS (SELECT cup, unnest(string_split(contractors, ' | ')) AS who, award_date, cig FROM rel),
firsts AS (SELECT cup, who, min(strftime(award_date, '%Y-%m-%d') || cig) AS first_at FROM lab GROUP BY cup, who),
con AS (SELECT cup, count(*) AS contractors_count, arg_min(who, first_at || who) AS head FROM firsts GROUP BY cup),
base AS (SELECT a.cup, a.title, a.value_eur, a.branch, a.year, coalesce(t.awards_count, 0) AS n, t.awards_total_eur, t.last_award_date, t.cigs,
    coalesce(c.contractors_count, 0) AS contractors_count,
    CASE WHEN c.contractors_count > 1 THEN head || ' + altri ' || (c.contractors_count - 1) || ' OE' ELSE head END AS contractors_summary
  FROM assigned a LEFT JOIN tot t USING (cup) LEFT JOIN con c USING (cup)),
flagged AS (SELECT *, n > 0 AS has_award, [x FOR x IN [
    CASE WHEN n = 0 THEN 'NO_ANAC_MATCH' END, CASE WHEN year < 1998 THEN 'OLD_CUP' END,
    CASE WHEN contains(title, 'NOT SPECIFIED') OR contains(title, 'FURNITURE') THEN 'GENERIC_OR_MAINTENANCE_TITLE' END,
    CASE WHEN value_eur >= 450000 AND n = 0 THEN 'HIGH_VALUE_WITHOUT_ANAC' END,
    CASE WHEN value_eur >= 400000 AND year < 1998 THEN 'OLD_HIGH_VALUE' END,
    CASE WHEN value_eur >= 400000 AND contains(title, 'LOW') THEN 'VALUE_SUSPICIOUS' END,
    CASE WHEN branch = 'AMBIGUA' THEN 'BRANCH_AMBIGUOUS' END, CASE WHEN branch = 'NON ASSEGNATA' THEN 'BRANCH_NOT_ASSIGNED' END]
    IF x IS NOT NULL] AS fl FROM base),
quality AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN n > 0 THEN 25 ELSE -8 END + CASE WHEN n > 1 THEN least(12, 2 * n) ELSE 0 END
    + CASE WHEN year >= 2001 THEN 8 ELSE 0 END + CASE WHEN value_eur >= 300000 THEN 8 WHEN value_eur >= 150000 THEN 4 ELSE 0 END
    - CASE WHEN list_contains(fl, 'OLD_CUP') THEN 12 ELSE 0 END - CASE WHEN list_contains(fl, 'GENERIC_OR_MAINTENANCE_TITLE') THEN 15 ELSE 0 END
    - CASE WHEN list_contains(fl, 'HIGH_VALUE_WITHOUT_ANAC') THEN 12 ELSE 0 END - CASE WHEN list_contains(fl, 'OLD_HIGH_VALUE') THEN 15 ELSE 0 END
    - CASE WHEN list_contains(fl, 'VALUE_SUSPICIOUS') THEN 25 ELSE 0 END - CASE WHEN list_contains(fl, 'BRANCH_AMBIGUOUS') THEN 4 ELSE 0 END
    - CASE WHEN list_contains(fl, 'BRANCH_NOT_ASSIGNED') THEN 10 ELSE 0 END)) AS commercial_score FROM flagged)"""
_RELIABILITY = "CASE WHEN commercial_score >= 75 THEN 'ALTA' WHEN commercial_score >= 50 THEN 'MEDIA' ELSE 'BASSA' END"
MASTER_SQL = f"""WITH {_MASTER} SELECT cup AS project_key, 0 AS part, title, value_eur, branch, has_award, n AS awards_count, awards_total_eur, last_award_date,
  contractors_count, contractors_summary, cigs, commercial_score, {_RELIABILITY} AS data_reliability,
  array_to_string(fl, ' | ') AS quality_flags FROM quality"""


def quality_score_flags(spark, sf) -> DataFrame:
    """Quality layer over the bare register with award counts."""
    counts = A.relevant(B.consolidated(spark, sf)).groupBy("cup").agg(F.count(F.lit(1)).alias("awards_count"))
    p = B.assigned(spark, sf).join(counts, "cup", "left").withColumns({
        "has_award": F.col("awards_count").isNotNull(), "code_year": F.col("year")})
    q = A.with_quality(p, **B.QUALITY)
    return q.select("cup", "commercial_score", "data_reliability", V.pipe_text(F.col("quality_flags")).alias("quality_flags"))


ENTRIES = {
    "dedupe_first_seen": (dedupe_first_seen, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag) = 1"""),
    "dedupe_max_value": (dedupe_max_value, """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity,
  l_discount, l_tax, l_returnflag) = 1"""),
    "best_target_per_project": (best_target_per_project, TARGET_SQL),
    "best_award_per_tender": (best_award_per_tender, f"""WITH {S.AWARDS},\n{_BEST_AWARD}
SELECT cig, cup, award_amount_eur, award_date, award_result, award_result_code, preference FROM best"""),
    "richest_metadata": (richest_metadata, f"WITH {S.PROJECTS},\n{_META}\nSELECT * FROM meta"),
    "representative_project": (representative_project,
        f"WITH {S.PROJECTS},\n{_META},\n{S.LINKS},\n{_REPRESENTATIVE}\nSELECT cig, cup FROM representative"),
    "identity_key": (identity_key, IDENTITY_SQL),
    "duplicate_codes": (duplicate_codes, f"WITH {S.LINKS} SELECT cup, count(*) AS count FROM links GROUP BY cup HAVING count(*) > 1 ORDER BY count DESC, cup LIMIT 25"),
    "link_semi_join": (link_semi_join, f"WITH {S.SHORTLISTED},\n{S.LINKS}\nSELECT cup, cig FROM links WHERE cup IN (SELECT cup FROM shortlist)"),
    "link_semi_join_raw": (link_semi_join_raw, f"""WITH {S.SHORTLISTED}
SELECT {S.CUP.format('l_orderkey')} AS cup, CASE WHEN l_linestatus = 'F' THEN {S.CIG.format('l_partkey')} ELSE '' END AS cig, l_returnflag AS source_dataset
FROM lineitem WHERE l_returnflag <> 'R' AND {S.CUP.format('l_orderkey')} IN (SELECT cup FROM shortlist)"""),
    "link_sets": (link_sets, LINK_SETS_SQL),
    "link_coverage": (link_coverage, COVERAGE_SQL),
    "code_set_ops": (code_set_ops, SETS_SQL),
    "tender_contractors": (tender_contractors, TENDER_CONTRACTORS_SQL),
    "project_contractors": (project_contractors, PROJECT_CONTRACTORS_SQL),
    "award_outcome_join": (award_outcome_join, OUTCOME_SQL),
    "register_without_awards": (register_without_awards, REGISTER_SQL),
    "award_consolidation": (award_consolidation, _CONSOLIDATED + f"SELECT {', '.join(_AWARD_COLUMNS)} FROM consolidated"),
    "contractor_sets": (contractor_sets, _CONSOLIDATED + """SELECT 0 AS part, contractors, contractor_tax_codes, coalesce(contractors_count, 0) AS contractors_count,
  count(*) AS n_awards FROM consolidated GROUP BY ALL"""),
    "relevant_awards": (relevant_awards, _CONSOLIDATED + f"SELECT {', '.join(_AWARD_COLUMNS)} FROM consolidated WHERE ratio_status = 'ok'"),
    "award_anomalies": (award_anomalies, _CONSOLIDATED + f"SELECT {', '.join(_AWARD_COLUMNS)} FROM consolidated WHERE ratio_status <> 'ok'"),
    "evidence_levels": (evidence_levels, f"""WITH {_LEVELS} SELECT cup, match_cig_count, enriched_cig_count, confirmed_awards_count,
  small_awards_count, review_awards_count, evidence_level FROM levels"""),
    "evidence_funnel": (evidence_funnel, FUNNEL_SQL),
    "master_projects": (master_projects, MASTER_SQL),
    "quality_score_flags": (quality_score_flags, f"""WITH {_MASTER} SELECT cup, commercial_score, {_RELIABILITY} AS data_reliability,
  array_to_string(fl, ' | ') AS quality_flags FROM quality"""),
}
