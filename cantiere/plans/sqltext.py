"""Plain-SQL building blocks of the oracle statements (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


def any_term(c: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"coalesce(contains({c}, {quoted(t)}), false)" for t in terms) + ")"


def case_rules(c: str, rules: Mapping[str, Sequence[str]], default: str) -> str:
    arms = " ".join(f"WHEN {any_term(c, terms)} THEN {quoted(label)}" for label, terms in rules.items())
    return f"CASE {arms} ELSE {default} END"


def case_steps(c: str, steps, below) -> str:
    show = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {c} >= {t} THEN {show(v)}" for t, v in steps) + f" ELSE {show(below)} END"


def geo(c: str) -> str:
    return f"trim(regexp_replace(upper({c}), '[^A-ZÀ-ÖØ-Ý0-9]+', ' ', 'g'))"


CUP = "'C' || lpad(CAST({} AS VARCHAR), 9, '0')"
CIG = "'T' || lpad(CAST({} AS VARCHAR), 9, '0')"

PROJECTS = f"""projects AS (
  SELECT {CUP.format('o_orderkey')} AS cup, o_orderpriority || ' ' || c_mktsegment AS title, c_mktsegment AS category,
         r_name AS region, n_name AS province, 'TOWN_' || CAST(c_custkey % 50 AS VARCHAR) AS municipality,
         CASE c_custkey % 4 WHEN 0 THEN 'COMUNE DI ' WHEN 1 THEN 'REGIONE ' WHEN 2 THEN 'PROVINCIA ' ELSE '' END || c_name AS client,
         o_totalprice AS value_eur, CASE o_orderstatus WHEN 'F' THEN 'CHIUSO' WHEN 'O' THEN 'ATTIVO' END AS status,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS decided_on,
         'https://register.example/' || {CUP.format('o_orderkey')} AS source_url
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""

# segment of the bound preset: by market segment, a second label for urgent orders
_SEG = """CASE category WHEN 'BUILDING' THEN 'Edilizia' WHEN 'MACHINERY' THEN 'Industria' WHEN 'AUTOMOBILE' THEN 'Verde'
              WHEN 'HOUSEHOLD' THEN 'Impiantisti' END"""
_URGENT = "contains(title, 'URGENT')"
_VALUE = ("CASE WHEN value_eur >= 450000 THEN -20 WHEN value_eur >= 400000 THEN -10 WHEN value_eur >= 350000 THEN 8 "
          "WHEN value_eur >= 300000 THEN 20 WHEN value_eur >= 200000 THEN 30 WHEN value_eur >= 100000 THEN 28 "
          "WHEN value_eur >= 50000 THEN 18 WHEN value_eur >= 20000 THEN 10 ELSE -30 END")
_YEAR = ("CASE WHEN year >= 2001 THEN 15 WHEN year >= 2000 THEN 12 WHEN year >= 1999 THEN 6 WHEN year >= 1998 THEN 0 "
         "WHEN year >= 1997 THEN -8 ELSE -15 END")
_CLIENT = ("CASE WHEN client LIKE 'COMUNE%' THEN 15 WHEN client LIKE 'PROVINCIA%' THEN 12 "
           "WHEN client LIKE 'REGIONE%' THEN 10 ELSE 0 END")
_STATUS = "CASE status WHEN 'CHIUSO' THEN -40 WHEN 'ATTIVO' THEN 8 ELSE 0 END"
MACRO = f"(value_eur >= 400000 AND {_URGENT})"

_BASE_SCORE = f"""CASE primary_segment WHEN 'Edilizia' THEN 30 WHEN 'Industria' THEN 18 WHEN 'Verde' THEN 12
    WHEN 'Impiantisti' THEN 10 WHEN 'Servizi' THEN 5 ELSE -10 END + {_VALUE} + {_CLIENT} + 10
    + CASE WHEN {MACRO} THEN -25 ELSE 0 END + 4"""

SEGMENTED = f"""segmented AS (
  SELECT *, coalesce({_SEG}, CASE WHEN {_URGENT} THEN 'Servizi' ELSE 'Altro' END) AS primary_segment,
         CASE WHEN {_URGENT} THEN coalesce({_SEG} || ' | ', '') || 'Servizi' ELSE coalesce({_SEG}, 'Altro') END AS segment_tags
  FROM projects)"""
SCORED = f"""scored AS (
  SELECT *, greatest(0, least(100, {_BASE_SCORE} + {_YEAR} + {_STATUS})) AS operational_score,
         greatest(0, least(100, {_BASE_SCORE})) AS reduced_score
  FROM segmented)"""
SHORTLIST = f"shortlist AS (SELECT * FROM scored WHERE NOT {MACRO} AND operational_score >= 45)"
SHORTLISTED = ",\n".join([PROJECTS, SEGMENTED, SCORED, SHORTLIST])

BAND = ("CASE WHEN value_eur >= 400000 THEN '>= 400k' WHEN value_eur >= 300000 THEN '300k - 400k' "
        "WHEN value_eur >= 200000 THEN '200k - 300k' WHEN value_eur >= 100000 THEN '100k - 200k' "
        "WHEN value_eur >= 50000 THEN '50k - 100k' WHEN value_eur >= 20000 THEN '20k - 50k' "
        "WHEN value_eur >= 10000 THEN '10k - 20k' ELSE '< 10k' END")
PHASE = ("CASE status WHEN 'ATTIVO' THEN 'programmazione / progetto attivo' WHEN 'CHIUSO' THEN 'chiuso' "
         "ELSE 'programmazione' END")
COMMERCIAL = f"""commercial AS (
  SELECT *, {PHASE} AS phase, {BAND} AS value_band,
    greatest(0, least(100, CASE WHEN category IN ('BUILDING','MACHINERY','HOUSEHOLD') THEN 25 ELSE 0 END
      + CASE WHEN value_eur >= 400000 THEN 35 WHEN value_eur >= 300000 THEN 30 WHEN value_eur >= 200000 THEN 22
             WHEN value_eur >= 100000 THEN 12 WHEN value_eur >= 50000 THEN 6 ELSE -20 END
      + 15 + 8 + 3 + 3 + 4)) AS commercial_score
  FROM projects)"""

AWARDS = f"""awards AS (
  SELECT {CUP.format('l_orderkey')} AS cup, {CIG.format('l_partkey')} AS cig, l_extendedprice AS award_amount_eur,
         CAST(l_shipdate AS DATE) AS award_date, CASE l_linestatus WHEN 'F' THEN 'AGGIUDICATA' ELSE 'DESERTA' END AS award_result,
         CAST(l_linenumber AS VARCHAR) AS award_result_code, l_discount AS award_discount, s_name AS contractor_name,
         CAST(l_suppkey AS VARCHAR) AS contractor_tax_code, l_returnflag AS contractor_role, l_quantity AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
LINKS = f"links AS (SELECT {CUP.format('l_orderkey')} AS cup, {CIG.format('l_partkey')} AS cig FROM lineitem)"

CONSOLIDATED = f"""valid AS (SELECT a.*, o_totalprice AS value_eur FROM awards a
    JOIN orders ON cup = {CUP.format('o_orderkey')} WHERE award_result = 'AGGIUDICATA' AND award_amount_eur >= 10000),
first_rows AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY cup, cig ORDER BY award_amount_eur DESC,
    award_result_code, contractor_tax_code, award_date, contractor_role, quantity, award_discount) = 1),
who AS (SELECT cup, cig, string_agg(label, ' | ' ORDER BY name, tax, role) AS contractors,
               count(*) AS contractors_count
        FROM (SELECT DISTINCT cup, cig, contractor_name AS name, contractor_tax_code AS tax, contractor_role AS role,
                     contractor_name || ' (' || contractor_role || ')' AS label FROM valid) GROUP BY cup, cig),
taxes AS (SELECT cup, cig, string_agg(tax, ' | ' ORDER BY tax) AS contractor_tax_codes
          FROM (SELECT DISTINCT cup, cig, contractor_tax_code AS tax FROM valid) GROUP BY cup, cig),
consolidated AS (
  SELECT f.cup, f.cig, f.value_eur, f.award_amount_eur, f.award_date, f.award_result,
         f.award_amount_eur / f.value_eur * 100 AS award_share_pct,
         CASE WHEN f.award_amount_eur / f.value_eur >= 0.5 THEN 'Appalto principale / molto rilevante'
              WHEN f.award_amount_eur / f.value_eur >= 0.1 THEN 'Lotto rilevante'
              WHEN f.award_amount_eur / f.value_eur >= 0.01 THEN 'Lotto / servizio significativo'
              ELSE 'Affidamento minore' END AS award_weight,
         CASE WHEN f.award_amount_eur / f.value_eur > 1.5 THEN 'anomalia'
              WHEN f.award_amount_eur / f.value_eur < 0.05 THEN 'anomalia' ELSE 'ok' END AS ratio_status,
         CASE WHEN f.award_amount_eur / f.value_eur > 1.5 THEN 'Importo aggiudicazione superiore al 150% del valore progetto'
              WHEN f.award_amount_eur / f.value_eur < 0.05 THEN 'Importo aggiudicazione inferiore allo 0,5% del valore progetto'
              ELSE 'Rapporto importo/valore coerente' END AS ratio_note,
         who.contractors, taxes.contractor_tax_codes, who.contractors_count
  FROM first_rows f JOIN who USING (cup, cig) JOIN taxes USING (cup, cig))"""

OFFICES = """offices AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), greatest(5, CAST(length(CAST(c_custkey AS VARCHAR)) AS INTEGER)), '0') AS cap,
         CASE WHEN c_custkey % 11 = 0 THEN 'BR_X' ELSE 'BR_' || CAST(c_nationkey % 8 AS VARCHAR) END AS branch,
         'TOWN_' || CAST(c_custkey % 50 AS VARCHAR) AS municipality, n_name AS province, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))"""
BRANCH_MAP = OFFICES + """,
branch_map AS (
  SELECT municipality, province, region, replace(municipality, '_', ' ') AS municipality_norm,
         replace(province, '_', ' ') AS province_norm,
         CASE WHEN count(DISTINCT branch) = 1 THEN min(branch) ELSE 'AMBIGUA' END AS branch,
         array_to_string(list_sort(list(DISTINCT branch)), ' | ') AS branch_candidates,
         CASE WHEN count(DISTINCT branch) = 1 THEN 'alta' ELSE 'bassa' END AS confidence,
         array_to_string(list_sort(list(DISTINCT cap)), ' | ') AS caps
  FROM offices GROUP BY municipality, province, region)"""
ASSIGNED = """assigned AS (
  SELECT p.*,
    CASE WHEN m.branch IS NOT NULL THEN m.branch
         WHEN p.province = 'NATION_1' THEN 'BR_P' WHEN p.province = 'NATION_9' THEN 'BR_Q'
         WHEN p.region = 'EUROPE' THEN 'BR_E' WHEN p.region = 'ASIA' THEN 'BR_A' ELSE 'NON ASSEGNATA' END AS branch,
    coalesce(m.branch_candidates, '') AS branch_candidates,
    CASE WHEN m.branch IS NOT NULL THEN m.confidence
         WHEN p.province IN ('NATION_1', 'NATION_9') THEN 'territoriale_provincia'
         WHEN p.region IN ('EUROPE', 'ASIA') THEN 'territoriale_regione' ELSE 'nessuna' END AS branch_confidence,
    CASE WHEN m.branch IS NOT NULL THEN 'exact_or_alias_province'
         WHEN p.province IN ('NATION_1', 'NATION_9') THEN 'fallback_provincia_territoriale'
         WHEN p.region IN ('EUROPE', 'ASIA') THEN 'fallback_regione_territoriale' ELSE 'none' END AS branch_assignment_method
  FROM projects p LEFT JOIN branch_map m ON m.municipality = p.municipality AND m.province = p.province)"""


def register_as_of(name: str, day: str) -> str:
    return f"""{name} AS (
  SELECT p.*, coalesce(a.awards_count, 0) AS awards_count, a.award_amount_eur, a.contractors, a.award_date,
         'BR_' || substring(p.province, 8, 2) AS branch
  FROM projects p LEFT JOIN (
    SELECT cup, count(*) AS awards_count, sum(CAST(award_amount_eur AS DECIMAL(18,2))) AS award_amount_eur,
           min(contractor_tax_code) AS contractors, max(award_date) AS award_date
    FROM awards WHERE award_date <= DATE '{day}' AND award_result = 'AGGIUDICATA' GROUP BY cup) a USING (cup)
  WHERE p.decided_on <= DATE '{day}'
    AND (p.status IS NULL OR p.status <> 'CHIUSO' OR p.decided_on + INTERVAL 48 MONTH >= DATE '{day}'))"""
