"""Catalogue: cleaning, classification and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantiere.functions import automaton
from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions import text as T
from cantiere.functions import values as V
from cantiere.operators import jsonflat, pages
from cantiere.operators.scale import computed_once
from cantiere.plans import bindings as B
from cantiere.plans import sqltext as S
from cantiere.sources.files import peek

# Rule tables that fire on the test texts (fixed values).
DOC_RULES = {"Licenza": ["license"], "Scuole": ["sch"], "Strumenti": ["ment"], "Azioni": ["tion", "action"]}
DOC_WEIGHTS = {"Azioni": 20, "Strumenti": 20, "Scuole": 25, "Licenza": 5}
DOC_NOISE, DOC_CANDIDATES = ["license", "password"], ["tion", "ment"]
PAGE_LABELS = ["The", "and", "of", "is", "to", "en"]
FUNDING = ("PROMO", "LARGE", "BRAND#2")


def clean_text_table(spark, sf) -> DataFrame:
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", T.known(T.repair(F.col("text"))).alias("clean_text"),
                    T.known(F.upper("lang"), ("EN", "N.D.")).alias("other_lang"))


_GLYPHS = "text"
for _bad, _good in (("Ã¨", "è"), ("Ã©", "é"), ("Ã ", "à"), ("Ã ", "à"), ("Ã²", "ò"), ("Ã¹", "ù"), ("Ã¬", "ì")):
    _GLYPHS = f"replace({_GLYPHS}, {S.quoted(_bad)}, {S.quoted(_good)})"
_GLYPHS = (f"replace(translate({_GLYPHS}, '‘’“”–—\u0091\u0092\u0093\u0094\u0096\u0097 ¿�', "
           f"'''''\"\"--''''\"\"-- '''''), '﻿', '')")
CLEAN_TEXT_SQL = f"""WITH t AS (SELECT doc_id, lang, {S.squeeze(_GLYPHS)} AS v FROM documents)
SELECT doc_id, CASE WHEN v = '' OR upper(v) IN ('DATO NON PRESENTE','NON PRESENTE','N.D.','ND','NO','N','-')
                      OR regexp_full_match(v, '\\*+') THEN NULL ELSE v END AS clean_text,
       CASE WHEN lang <> 'en' THEN upper(lang) END AS other_lang FROM t"""


def locale_decimal_parse(spark, sf) -> DataFrame:
    o = B.table(spark, sf, "orders")
    local = F.concat(F.lit("€ "), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    return o.select("o_orderkey", V.money(local).alias("parsed_local"),
                    V.money(F.col("o_totalprice").cast("string")).alias("parsed_plain"),
                    V.money(F.col("o_orderpriority")).alias("parsed_text"))


def geo_key_normalise(spark, sf) -> DataFrame:
    p = B.table(spark, sf, "part").withColumnRenamed("p_brand", "P Brand")
    keys = p.select(F.col("p_partkey").alias("id"), T.geo_key(T.first_present(p, ["brand name", "p_brand"])).alias("key"),
                    T.geo_key(F.concat(F.lit("L'"), "p_name", F.lit("-è"))).alias("name_key"))
    n = B.table(spark, sf, "nation")
    return keys.unionByName(n.select(F.col("n_nationkey").cast("bigint").alias("id"), T.geo_key(F.col("n_name")).alias("key"),
                                     F.lit(None).cast("string").alias("name_key")))


def code_extract_and_year(spark, sf) -> DataFrame:
    o = B.table(spark, sf, "orders")
    code = F.concat(F.lit("F"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lit("H"),
                    F.date_format("o_orderdate", "yy"), V.zero_pad(F.col("o_orderkey"), 9))
    raw = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x-"), F.col("o_orderkey"))).otherwise(
        F.concat(F.lit("codice  "), code, F.lit(" fine")))
    notes = F.concat(F.lit("Settore: x | Anno Decisione:  "), F.year("o_orderdate"))
    o = o.withColumn("raw", raw).withColumn("code", V.code(F.col("raw")))
    return o.select("o_orderkey", "code", V.code_year(F.col("code")).alias("code_year"), V.labelled_year(notes).alias("label_year"))


CODE_SQL = """WITH c AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'x-' || CAST(o_orderkey AS VARCHAR)
   ELSE 'F' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || 'H' || strftime(o_orderdate, '%y')
        || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS code FROM orders)
SELECT o_orderkey, code,
  CASE WHEN regexp_full_match(substring(code, 5, 2), '[0-9]{2}') THEN
    CASE WHEN CAST(substring(code, 5, 2) AS INTEGER) <= 40 THEN 2000 ELSE 1900 END + CAST(substring(code, 5, 2) AS INTEGER) END AS code_year,
  CAST(year(o_orderdate) AS INTEGER) AS label_year FROM c"""


def postal_code_normalise(spark, sf) -> DataFrame:
    c = B.table(spark, sf, "customer")
    return c.select("c_custkey", V.postal_code(F.concat(F.lit("CAP-"), F.col("c_custkey"))).alias("cap"),
                    V.postal_code(F.col("c_mktsegment")).alias("no_cap"))


def date_parse_multi(spark, sf) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    text = (
        F.when(F.col("l_returnflag") == "N", F.lit("2024-13-01"))
        .when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("l_shipdate", "dd/MM/yyyy"))
    )
    return li.groupBy(V.parse_date(text).alias("parsed_on"), "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"))


def composite_split(spark, sf) -> DataFrame:
    p = B.table(spark, sf, "part")
    size = F.col("p_size")
    text = (
        F.when(size < 10, F.col("p_name"))
        .when(size < 20, F.concat("p_name", F.lit(" * "), "p_brand"))
        .when(size < 40, F.concat_ws("*", "p_name", "p_brand", "p_type"))
        .otherwise(F.concat_ws("*", "p_name", F.lit(" "), F.lit("  "), "p_type"))
    )
    c = V.composite(text)
    street = F.when(size >= 20, F.col("p_type"))
    return p.select(
        "p_partkey", c["title"].alias("title"), c["location"].alias("location"), c["description"].alias("description"),
        V.joined_or([street, F.when(size >= 30, F.col("p_name"))], c["location"]).alias("address"),
        V.first_flagged([F.col("p_name"), F.col("p_brand"), F.col("p_type")], FUNDING).alias("funding"),
    )


COMPOSITE_SQL = """SELECT p_partkey, p_name AS title,
  CASE WHEN p_size >= 10 AND p_size < 40 THEN p_brand END AS location,
  CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN p_name || ' * ' || p_brand WHEN p_size < 40 THEN p_type END AS description,
  CASE WHEN p_size >= 30 THEN p_type || ' ' || p_name WHEN p_size >= 20 THEN p_type
       WHEN p_size >= 10 THEN p_brand END AS address,
  CASE WHEN p_brand = 'Brand#2' THEN p_brand WHEN p_type IN ('PROMO', 'LARGE') THEN p_type END AS funding FROM part"""


def evidence_gate(spark, sf) -> DataFrame:
    li = B.table(spark, sf, "lineitem").join(
        B.table(spark, sf, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "A", F.col("l_partkey").cast("string")).alias("cig"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("award_amount"),
        F.col("s_name").alias("contractor_name"), F.col("s_suppkey").cast("string").alias("contractor_vat"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Mario "), "s_name")).when(
            F.col("l_returnflag") == "A", F.lit("27.5")).otherwise(F.col("s_name")).alias("contact"),
    )
    evidence = V.has_text(F.col("cig")) | (F.coalesce(F.col("award_amount"), F.lit(0.0)) != 0)
    gated = rows.withColumns(V.gated(["contractor_name", "contractor_vat"], evidence))
    person = F.when(T.person_name(F.col("contact")), F.col("contact"))
    return gated.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        T.first_alias(gated, "company", "contractor_name").alias("contractor_name"), "contractor_vat",
                        person.alias("contact_name"), F.when(person.isNotNull(), F.lit("RUP")).alias("contact_role"))


EVIDENCE_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN s_name END AS contractor_name,
  CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN CAST(s_suppkey AS VARCHAR) END AS contractor_vat,
  CASE WHEN l_returnflag = 'R' THEN 'Mario ' || s_name END AS contact_name,
  CASE WHEN l_returnflag = 'R' THEN 'RUP' END AS contact_role
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


def json_flatten(spark, sf) -> DataFrame:
    e = B.table(spark, sf, "events")
    doc = F.concat(F.lit('{"type":"'), "event_type", F.lit('","data":'), "props", F.lit(',"tags":["'), "event_type",
                   F.lit('",{"user":'), F.col("user_id"), F.lit('}],"none":[],"gap":[null,null],"hole":[null],"nil":null,"note":"{[\\"]}"}'))
    return jsonflat.flatten_json(e.withColumn("doc", doc), "doc", ["event_id"])


JSON_SQL = """SELECT event_id, 'type' AS key, event_type AS value FROM events
UNION ALL SELECT event_id, 'data_' || j.key, json_extract_string(props, '$."' || j.key || '"') FROM events, json_each(props) j
UNION ALL SELECT event_id, 'tags_0', event_type FROM events
UNION ALL SELECT event_id, 'tags_1_user', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, unnest(['gap_0', 'gap_1', 'hole_0', 'nil']), NULL FROM events
UNION ALL SELECT event_id, 'note', '{["]}' FROM events"""


def pipe_pairs(spark, sf) -> DataFrame:
    p = B.table(spark, sf, "part")
    names = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" | ")), F.lit(" | | ultimo"))
    taxes = F.concat_ws("|", "p_brand", "p_type")
    pair = F.inline(V.pipe_pairs(names, taxes))
    return p.select("p_partkey", pair)


PAIRS_SQL = """SELECT p_partkey, split_part(p_name, ' ', 1) AS name, p_brand AS tax FROM part
UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2), p_type FROM part
UNION ALL SELECT p_partkey, 'ultimo', NULL FROM part"""


def slugify_branches(spark, sf) -> DataFrame:
    n = B.table(spark, sf, "nation")
    named = F.concat(F.lit("Città  d'"), T.display_name(F.col("n_name"), {"NATION_3": "Nàtion Tre"}), F.lit(" (Ò) Łódź Škoda ﬁn Ǆ ½ Ąę ８"))
    return n.select("n_nationkey", T.slug(named).alias("slug"),
                    T.slug(F.when(F.col("n_regionkey") == 0, F.lit("Ambigua"))).alias("sentinel"))


SLUG_SQL = """SELECT n_nationkey, CASE WHEN n_name = 'NATION_3' THEN 'Citta_d_Nation_Tre' ELSE 'Citta_d_' || n_name END || '_O_odz_Skoda_fin_DZ_12_Ae_8' AS slug,
  CASE WHEN n_regionkey = 0 THEN 'AMBIGUA' ELSE 'NON_ASSEGNATA' END AS sentinel FROM nation"""


def column_profile(spark, sf) -> DataFrame:
    c = B.table(spark, sf, "customer")
    code = T.find_column(c.columns, ["customer key", "custkey"])
    return peek(c.withColumnRenamed(code, "key"), [F.asc("key")])


PROFILE_SQL = """WITH h AS (SELECT row_number() OVER (ORDER BY c_custkey) AS "row", CAST(c_custkey AS VARCHAR) AS k, c_name AS n,
   CAST(c_nationkey AS VARCHAR) AS nk, CAST(c_acctbal AS VARCHAR) AS a, c_mktsegment AS m FROM customer ORDER BY c_custkey LIMIT 3)
SELECT CAST("row" AS INTEGER) AS "row", 'key' AS field, k AS value FROM h UNION ALL SELECT "row", 'c_name', n FROM h
UNION ALL SELECT "row", 'c_nationkey', nk FROM h UNION ALL SELECT "row", 'c_acctbal', a FROM h
UNION ALL SELECT "row", 'c_mktsegment', m FROM h"""


# -- classification ----------------------------------------------------------


#: Every second document also says one word of the presets, in turn, so that each of them is met.
PRESET_WORDS = R.distinct_terms(P.NATIONAL_CATEGORIES, P.CATEGORIES, P.INTERVENTION_TYPES, P.SEGMENT_TERMS, P.ENVIRONMENT_UTILITY_TERMS,
                                P.NATIONAL_NOISE, P.NATIONAL_CANDIDATES, P.LIGHT_PROJECT_NOISE, P.GENERIC_WORK_WORDS)


def _docs(spark, sf) -> DataFrame:
    """Documents with their normalised text ``t``, computed once per row."""
    words = F.array(*[F.lit(w) for w in PRESET_WORDS])
    said = F.get(words, (F.floor(F.col("doc_id") / 2) % len(PRESET_WORDS)).cast("int"))
    text = F.concat(T.lower_text(F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), said)).otherwise(F.lit("")))
    return computed_once(B.table(spark, sf, "documents"), {"t": text})


_SAID = f"[{', '.join(S.quoted(w) for w in PRESET_WORDS)}][CAST(doc_id // 2 % {len(PRESET_WORDS)} AS INTEGER) + 1]"
_DOC = f"(SELECT doc_id, source, lang, lower({S.squeeze('text')}) || CASE WHEN doc_id % 2 = 0 THEN ' ' || {_SAID} ELSE '' END AS t FROM documents)"


def _searched(docs: DataFrame, *tables, text="t", found="found") -> tuple[DataFrame, R.Matched]:
    """Texts with the terms of all tables that they hold, searched once."""
    words = R.distinct_terms(*tables)
    return computed_once(docs, {found: automaton.found_terms(F.expr(text), words)}), R.Matched(F.col(found), words)


def taxonomy_first_match(spark, sf) -> DataFrame:
    d, found = _searched(_docs(spark, sf), DOC_RULES, P.NATIONAL_CATEGORIES, P.CATEGORIES, P.INTERVENTION_TYPES)
    d, phases = _searched(d, P.PHASES, text="upper(t)", found="phases")
    return d.select("doc_id", R.first_match(found, DOC_RULES, P.OTHER).alias("label"),
                    D.category(found).alias("category"), D.category(found, P.CATEGORIES).alias("regional_category"),
                    D.intervention_type(found).alias("intervention_type"),
                    D.phase(phases).alias("phase"))


TAXONOMY_SQL = f"""SELECT doc_id, {S.case_rules('t', DOC_RULES, "'Altro'")} AS label,
  {S.case_rules('t', P.NATIONAL_CATEGORIES, "'Altro'")} AS category,
  {S.case_rules('t', P.CATEGORIES, "'Altro'")} AS regional_category,
  {S.case_rules('t', P.INTERVENTION_TYPES, 'NULL')} AS intervention_type,
  {S.case_rules('upper(t)', P.PHASES, "'programmazione'")} AS phase FROM {_DOC}"""


def segments_multi_label(spark, sf) -> DataFrame:
    d, found = _searched(_docs(spark, sf), DOC_RULES, P.SEGMENT_TERMS, P.ENVIRONMENT_UTILITY_TERMS)
    own = R.ranked_labels({k: R.contains_any(found, v) for k, v in DOC_RULES.items()}, DOC_WEIGHTS)
    tagged = d.select("doc_id", own.alias("own"), D.segments(found, F.col("source")).alias("preset"))
    return tagged.select("doc_id", F.get("own", F.lit(0)).alias("primary_segment"), V.pipe_text(F.col("own")).alias("segment_tags"),
                         V.pipe_text(F.col("preset")).alias("preset_tags"))


def _label_list(rules, weights) -> str:
    order = sorted(rules, key=lambda k: (-weights[k], k))
    arms = ", ".join(f"CASE WHEN {S.any_term('t', rules[k])} THEN {S.quoted(k)} END" for k in order)
    return f"coalesce(nullif(array_to_string([x FOR x IN [{arms}] IF x IS NOT NULL], ' | '), ''), 'Altro')"


SEGMENTS_SQL = f"""WITH g AS (SELECT doc_id, {_label_list(DOC_RULES, DOC_WEIGHTS)} AS segment_tags,
  {_label_list(P.SEGMENT_TERMS, P.SEGMENT_WEIGHTS)} AS preset_tags FROM {_DOC})
SELECT doc_id, split_part(segment_tags, ' | ', 1) AS primary_segment, segment_tags, preset_tags FROM g"""


def noise_and_candidate_filter(spark, sf) -> DataFrame:
    d, t = _searched(_docs(spark, sf), DOC_NOISE, DOC_CANDIDATES, P.NATIONAL_NOISE, P.NATIONAL_CANDIDATES, P.LIGHT_PROJECT_NOISE,
                     P.CATEGORIES, P.GENERIC_WORK_WORDS)
    return d.filter(~R.contains_any(t, DOC_NOISE) & R.contains_any(t, DOC_CANDIDATES)).select(
        "doc_id", D.is_noise(t).alias("national_noise"), D.is_candidate(t).alias("national_candidate"),
        D.is_regional_candidate(t).alias("regional_candidate"))


NOISE_SQL = f"""SELECT doc_id, {S.any_term('t', P.NATIONAL_NOISE)} AS national_noise,
  {S.any_term('t', P.NATIONAL_CANDIDATES)} AS national_candidate,
  NOT {S.any_term('t', P.LIGHT_PROJECT_NOISE)} AND ({S.case_rules('t', P.CATEGORIES, "'Altro'")} <> 'Altro'
     OR {S.any_term('t', P.GENERIC_WORK_WORDS)}) AS regional_candidate
FROM {_DOC} WHERE NOT {S.any_term('t', DOC_NOISE)} AND {S.any_term('t', DOC_CANDIDATES)}"""


def client_and_macro_predicates(spark, sf) -> DataFrame:
    p = B.projects(spark, sf)
    status = D.clean_status(F.concat_ws(" ", F.lit("stato"), "status"))
    return p.select(
        "cup", D.is_local_client(F.col("client")).alias("local_client"), B.macro_project().alias("macro"),
        status.alias("status"), D.is_live(F.col("status"), D.phase(F.col("status"))).alias("live"),
        D.clean_status(F.col("region")).alias("region_as_status"),
    )


PREDICATES_SQL = f"""WITH {S.PROJECTS}
SELECT cup, client LIKE 'COMUNE%' OR client LIKE 'REGIONE%' OR client LIKE 'PROVINCIA%' AS local_client, {S.MACRO} AS macro,
  'STATO ' || status AS status, status IS NULL OR status <> 'CHIUSO' AS live, CAST(NULL AS VARCHAR) AS region_as_status FROM projects"""


# -- pages -------------------------------------------------------------------


def page_features(spark, sf) -> DataFrame:
    p = B.table(spark, sf, "pages")
    f = pages.page_features(p, r"/[a-z]+/(\d+)", "PAGE-", sectors={"azione": ["tion"], "altro": ["ment"]}, default_sector="nessuno")
    found = V.pipe_text(pages.links(F.col("html"), "^/", "https://portal.example"))
    f = f.withColumn("links", found)
    f = pages.dedupe_pages(f, [F.asc("url"), F.asc("page_id")])  # one url may have been fetched several times
    return f.select("external_id", "url", "title", "description", "sector", "phase", "power_mw", "municipality", "province",
                    "client_type", "links")


_VISIBLE = ("regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g')")


def _unescape_sql(c: str) -> str:
    for bad, good in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, {S.quoted(bad)}, {S.quoted(good)})"
    return c


def _text_sql(c: str) -> str:
    return S.squeeze(_unescape_sql(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"))


PAGE_TEXT = f"""v AS (SELECT page_id, url, html, {_VISIBLE} AS body FROM pages),
t AS (SELECT *, {_text_sql('body')} AS txt,
  {_text_sql("regexp_extract(body, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)")} AS h1 FROM v)"""
PAGES_SQL = f"""WITH {PAGE_TEXT},
f AS (SELECT 'PAGE-' || nullif(regexp_extract(url, '/[a-z]+/([0-9]+)', 1), '') AS external_id, url, txt, h1, lower(txt) AS low, html FROM t)
SELECT external_id, url, coalesce(nullif(h1, ''), nullif({S.squeeze("regexp_extract(txt, '(?i)(Progetto[^.]{20,250})', 1)")}, ''),
         concat_ws(' ', 'Progetto', external_id)) AS title,
  nullif({S.squeeze('substring(txt, 1, 900)')}, '') AS description,
  CASE WHEN contains(low, 'tion') THEN 'azione' WHEN contains(low, 'ment') THEN 'altro' ELSE 'nessuno' END AS sector,
  CASE WHEN contains(low, 'verifica di assoggettabilità') THEN 'verifica assoggettabilità VIA' WHEN contains(low, 'via') THEN 'VIA'
       WHEN contains(low, 'provvedimento') AND contains(low, 'positivo') THEN 'provvedimento positivo'
       WHEN contains(low, 'osservazioni') THEN 'osservazioni' WHEN contains(low, 'integrazioni') THEN 'richiesta integrazioni'
       ELSE 'procedura ambientale' END AS phase,
  CAST(nullif(regexp_extract(replace(replace(txt, '.', ''), ',', '.'), '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*MWp?\\b', 1), '') AS DOUBLE) AS power_mw,
  nullif(regexp_extract(txt, '(?i)\\bcomune di ([A-Za-zÀ-ÖØ-öø-ÿ''’\\-\\s]+?)(?:[,.;)]|\\s+e\\s+|$)', 1), '') AS municipality,
  nullif(regexp_extract(txt, '(?i)\\(([A-Z]{{2}})\\)', 1), '') AS province,
  CASE WHEN regexp_matches(txt, '(?i)Proponente\\s+.') THEN 'privato' END AS client_type,
  array_to_string(list_sort(list_distinct(['https://portal.example' || u FOR u IN
     regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) IF u LIKE '/%'])), ' | ') AS links
FROM f QUALIFY row_number() OVER (PARTITION BY coalesce(external_id, url) ORDER BY url) = 1"""


def page_fields(spark, sf) -> DataFrame:
    p = B.table(spark, sf, "pages").withColumn("txt", pages.visible_text(F.col("html")))
    out = pages.labelled_fields(p, "txt", {"after_the": "The", "after_of": "of"}, PAGE_LABELS)
    return out.select("page_id", "after_the", "after_of")


_STOP = "(?:\\s+(?:The|and|of|is|to|en)\\s+|$)"
FIELDS_SQL = f"""WITH {PAGE_TEXT} SELECT page_id,
  nullif(trim(regexp_extract(txt, '(?i)The\\s+(.+?){_STOP}', 1)), '') AS after_the,
  nullif(trim(regexp_extract(txt, '(?i)of\\s+(.+?){_STOP}', 1)), '') AS after_of FROM t"""


def power_extract(spark, sf) -> DataFrame:
    d = B.table(spark, sf, "documents")
    unit = F.when(F.col("n_chars") % 2 == 0, F.lit(",25 kWp.")).otherwise(F.lit(",5 MW"))
    text = F.concat("text", F.lit(" impianto da "), F.col("n_chars"), unit)
    return d.select("doc_id", pages.power_mw(text).alias("power_mw"))


POWER_SQL = """SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN round((n_chars + 0.25::DOUBLE) / 1000, 3) ELSE n_chars + 0.5::DOUBLE END AS power_mw
FROM documents"""

ENTRIES = {
    "clean_text_table": (clean_text_table, CLEAN_TEXT_SQL),
    "locale_decimal_parse": (locale_decimal_parse,
        "SELECT o_orderkey, o_totalprice AS parsed_local, o_totalprice AS parsed_plain, CAST(NULL AS DOUBLE) AS parsed_text FROM orders"),
    "geo_key_normalise": (geo_key_normalise,
        "SELECT p_partkey AS id, replace(upper(p_brand), '#', ' ') AS key, 'L ' || upper(p_name) || ' È' AS name_key FROM part "
        "UNION ALL SELECT n_nationkey, replace(n_name, '_', ' '), NULL FROM nation"),
    "code_extract_and_year": (code_extract_and_year, CODE_SQL),
    "postal_code_normalise": (postal_code_normalise,
        "SELECT c_custkey, CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END AS cap, "
        "CAST(NULL AS VARCHAR) AS no_cap FROM customer"),
    "date_parse_multi": (date_parse_multi,
        "SELECT CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) END AS parsed_on, l_linestatus, count(*) AS n_rows "
        "FROM lineitem GROUP BY 1, 2"),
    "composite_split": (composite_split, COMPOSITE_SQL),
    "evidence_gate": (evidence_gate, EVIDENCE_SQL),
    "json_flatten": (json_flatten, JSON_SQL),
    "pipe_pairs": (pipe_pairs, PAIRS_SQL),
    "slugify_branches": (slugify_branches, SLUG_SQL),
    "column_profile": (column_profile, PROFILE_SQL),
    "taxonomy_first_match": (taxonomy_first_match, TAXONOMY_SQL),
    "segments_multi_label": (segments_multi_label, SEGMENTS_SQL),
    "noise_and_candidate_filter": (noise_and_candidate_filter, NOISE_SQL),
    "client_and_macro_predicates": (client_and_macro_predicates, PREDICATES_SQL),
    "page_features": (page_features, PAGES_SQL),
    "page_fields": (page_fields, FIELDS_SQL),
    "power_extract": (power_extract, POWER_SQL),
}
