"""National pipeline on register and tender files: raw rows to master, levels and shards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions import text as T
from cantiere.functions import values as V
from cantiere.operators import awards as A
from cantiere.operators import dedupe, geo, link, shards, topk
from cantiere.operators.classify import with_categories, with_operational_score, with_segments
from cantiere.operators.scale import computed_once
from cantiere.sources import files

# Position of the register columns (fixed values of the published file layout).
POSITIONS = {
    "cup_raw": 0, "composite": 1, "year_text": 2, "status_raw": 3, "cost": 4, "region": 11, "province_code": 13,
    "province_name": 14, "municipality": 16, "client": 17, "street_name": 19, "street_type": 20, "street_number": 21,
    "classification": 33, "nature": 35, "typology": 37, "area": 39, "sector_raw": 41, "subsector": 43, "register_category": 45,
    "description_raw": 48, "title_raw": 52, "location_hint": 53,
}
FUNDING_RANGE = (55, 80)

# Header candidates of the register by name (fixed values of the published headers).
HEADERS = {
    "cup_raw": ["cup", "codice cup", "codice unico progetto"],
    "title_raw": ["descrizione intervento", "titolo progetto", "denominazione progetto", "descrizione",
                  "struttura infrastruttura oggetto dell intervento"],
    "description_raw": ["descrizione intervento", "struttura infrastruttura oggetto dell intervento", "altre informazioni"],
    "classification": ["classificazione", "natura", "classificazione progetto"],
    "typology": ["tipologia", "tipologia intervento", "tipo intervento"],
    "area": ["area intervento", "area d'intervento", "area_di_intervento"],
    "sector_raw": ["settore", "settore intervento"], "subsector": ["sottosettore", "sotto settore"],
    "register_category": ["categoria", "categoria intervento"],
    "status_raw": ["stato progetto", "stato del progetto", "stato cup", "stato intervento", "stato"],
    "year_text": ["anno decisione"], "region": ["regione", "den regione"],
    "province_name": ["provincia", "den provincia", "sigla provincia"], "municipality": ["comune", "den comune"],
    "address": ["indirizzo", "indirizzo o area di riferimento", "area riferimento"],
    "client": ["soggetto titolare", "denominazione soggetto titolare", "denominazione", "beneficiario"],
    "cost": ["totale costo previsto", "costo previsto", "importo", "finanziamento", "totale finanziamento pubblico previsto"],
    "funding": ["copertura finanziaria", "fonte copertura", "fonte di copertura", "finanziamento"],
    "cig": ["cig", "codice cig", "smart cig", "codice identificativo gara"],
    "contractor_name": ["aggiudicatario", "denominazione aggiudicatario", "ditta aggiudicataria", "impresa aggiudicataria",
                        "operatore economico", "operatore economico aggiudicatario", "contraente", "appaltatore",
                        "soggetto realizzatore", "realizzatore", "impresa", "ragione sociale impresa"],
    "contractor_vat": ["partita iva aggiudicatario", "p iva aggiudicatario", "partita iva operatore economico",
                       "p iva operatore economico", "partita iva impresa", "p iva impresa", "partita iva", "p iva"],
    "contractor_tax_code": ["codice fiscale aggiudicatario", "cf aggiudicatario", "codice fiscale operatore economico",
                            "cf operatore economico", "codice fiscale impresa", "cf impresa", "codice fiscale"],
    "contractor_address": ["indirizzo aggiudicatario", "sede legale aggiudicatario", "indirizzo operatore economico",
                           "sede legale operatore economico", "indirizzo impresa", "sede legale impresa"],
    "contractor_city": ["comune aggiudicatario", "citta aggiudicatario", "comune operatore economico",
                        "citta operatore economico", "comune impresa", "citta impresa"],
    "contractor_province": ["provincia aggiudicatario", "provincia operatore economico", "provincia impresa",
                            "sigla provincia aggiudicatario"],
    "contractor_pec": ["pec aggiudicatario", "pec operatore economico", "pec impresa", "pec"],
    "contractor_email": ["email aggiudicatario", "mail aggiudicatario", "email operatore economico", "email impresa",
                         "mail impresa", "email"],
    "contractor_phone": ["telefono aggiudicatario", "telefono operatore economico", "telefono impresa", "telefono", "tel"],
    "rup": ["rup", "responsabile unico del progetto", "responsabile unico del procedimento", "responsabile progetto",
            "responsabile procedimento"],
    "contact_name": ["referente", "nominativo referente", "referente procedura", "contatto", "responsabile"],
    "contact_role": ["ruolo referente", "qualifica referente", "ufficio"],
    "contact_email": ["email referente", "mail referente", "email rup", "mail rup", "email responsabile", "mail responsabile"],
    "contact_phone": ["telefono referente", "tel referente", "telefono rup", "tel rup", "telefono responsabile"],
    "award_amount": ["importo aggiudicazione", "importo di aggiudicazione", "valore aggiudicazione", "importo contrattuale"],
    "award_date": ["data aggiudicazione", "data di aggiudicazione", "data affidamento", "data esito"],
    "award_url": ["url aggiudicazione", "link aggiudicazione", "url esito", "link esito", "url fonte aggiudicazione"],
}
CONTRACTOR_FIELDS = [h for h in HEADERS if h.startswith("contractor_")]
PLAIN_HEADERS = ("cup_raw", "title_raw", "description_raw", "classification", "typology", "area", "sector_raw", "subsector",
                 "register_category", "status_raw", "year_text", "region", "province_name", "municipality", "address", "client",
                 "cost", "funding")


def _notes(parts: dict[str, str]) -> Column:
    texts = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(""))) for label, c in parts.items()]
    return F.concat_ws(" | ", *texts)


def parse_positional(raw: DataFrame, url_prefix: str = "", min_value: float = P.MIN_PROJECT_VALUE) -> DataFrame:
    """Projects from positional register rows (``_c0`` .. ``_c79``).

    The value filter comes first so that dropped rows are never cleaned or classified.
    """
    columns = {n: F.col(f"_c{i}") for n, i in POSITIONS.items()}
    keep = [c for c in ("_source_order", "_file", "_member", "_row") if c in raw.columns]
    cost = V.money(T.known(columns["cost"]))
    rows = raw.withColumn("value_eur", cost).filter(
        (F.coalesce(F.col("value_eur"), F.lit(min_value)) >= min_value) & T.known(columns["cup_raw"]).isNotNull()
    )
    named = {n: T.known(c) for n, c in columns.items() if n not in ("cost", "composite")}
    funding = V.first_flagged([F.col(f"_c{i}") for i in range(*FUNDING_RANGE)], P.FUNDING_WORDS)
    clean = rows.select("value_eur", *keep, *[c.alias(n) for n, c in named.items()],
                        T.known(columns["composite"]).alias("composite"), funding.alias("funding"))
    clean = clean.withColumn("parts", V.composite(F.col("composite"))).withColumns({
        "cup": V.code(F.col("cup_raw")),
        "description": F.coalesce("description_raw", "parts.description"),
        "address": V.joined_or([F.col("street_type"), F.col("street_name"), F.col("street_number")], F.col("parts.location")),
        "province": F.coalesce("province_name", "province_code"), "status": D.clean_status(F.col("status_raw")),
    })
    title = F.coalesce("title_raw", "parts.title", "description", F.concat(F.lit("Progetto "), F.col("cup")))
    clean = clean.withColumn("title", title)
    text = ["title", "description", "location_hint", "classification", "nature", "typology", "area", "sector_raw", "subsector", "register_category"]
    noise = [c for c in text if c != "location_hint"]
    staged = computed_once(clean, {"_all": T.lower_joined(*text), "_noise": T.lower_joined(*noise)})
    kept = staged.filter(~D.is_noise(F.col("_noise")) & D.is_candidate(F.col("_all"))).drop("_noise")
    out = kept.withColumns({
        "category": D.category(F.col("_all")), "intervention_type": D.intervention_type(F.col("_all")),
        "phase": D.phase(F.col("status")), "sector": F.coalesce("sector_raw", "area", "nature", "classification"),
        "year": F.col("year_text").try_cast("int"),
        "source_url": F.concat(F.lit(url_prefix), F.col("cup")), "external_id": F.concat(F.lit("REGISTER-"), F.col("cup")),
        "client_type": F.lit("pubblico"),
        "notes": _notes({"Classificazione": "classification", "Natura": "nature", "Tipologia": "typology", "Area": "area",
                         "Settore": "sector_raw", "Sottosettore": "subsector", "Anno decisione": "year_text"}),
    })
    score = D.commercial_score_v2(*[F.col(c) for c in ("category", "value_eur", "phase", "intervention_type", "client", "region", "province", "municipality")])
    return out.withColumn("commercial_score", score).drop(
        "_all", "parts", "composite", "cup_raw", "description_raw", "title_raw", "status_raw", "sector_raw", "province_name", "province_code",
        "street_name", "street_type", "street_number")


def parse_named(raw: DataFrame, url_prefix: str = "", min_value: float = P.MIN_PROJECT_VALUE) -> DataFrame:
    """Projects from register rows with named columns; headers are matched loosely.

    Contractor fields survive only with procurement evidence, contacts only as plausible persons.
    """
    keep = [c for c in ("_source_order", "_file", "_member", "_row") if c in raw.columns]
    data = raw.drop(*keep)
    value = lambda n: T.first_present(data, HEADERS[n]) if n in PLAIN_HEADERS else T.known(T.first_present(data, HEADERS[n]))
    rows = raw.select(*keep, *[value(n).alias(n) for n in HEADERS])
    rows = rows.withColumns({
        "cup": V.code(F.col("cup_raw")), "value_eur": V.money(F.col("cost")), "award_amount_eur": V.money(F.col("award_amount")),
        "status": D.clean_status(F.col("status_raw")), "description": F.col("description_raw"),
    })
    rows = rows.filter(F.coalesce(F.col("value_eur"), F.lit(min_value)) >= min_value)
    evidence = F.col("cig").isNotNull() | F.col("award_date").isNotNull() | (F.coalesce(F.col("award_amount_eur"), F.lit(0.0)) != 0) | F.col("award_url").isNotNull()
    rows = rows.withColumn("evidence", evidence).withColumn("has_rup", F.col("rup").isNotNull())
    rows = rows.withColumns(V.gated(CONTRACTOR_FIELDS, F.col("evidence")))
    contact = F.coalesce("contact_name", "rup")
    rows = rows.withColumn("contact_name", contact).withColumn("rup", F.when(T.person_name(F.col("rup")), F.col("rup")))
    rows = rows.withColumn("contact_name", F.when(T.person_name(F.col("contact_name")), F.col("contact_name")).otherwise(F.col("rup")))
    rows = rows.withColumn("contact_role", F.when(F.col("has_rup"), F.lit("RUP / responsabile procedimento")).otherwise(F.col("contact_role")))
    rows = rows.withColumns(V.gated(["contact_role", "contact_email", "contact_phone"], F.col("rup").isNotNull() | F.col("contact_name").isNotNull()))
    rows = rows.withColumn("title", F.coalesce("title_raw", F.concat_ws(" ", F.lit("Progetto"), F.col("cup"))))
    text = ["title", "description", "classification", "typology", "area", "sector_raw", "subsector", "register_category"]
    staged = computed_once(rows, {"_all": T.lower_joined(*text)})
    kept = staged.filter(~D.is_noise(F.col("_all"), P.NON_CONSTRUCTION_NOISE) & D.is_regional_candidate(F.col("_all"))).drop("_all")
    out = with_categories(kept, text, P.CATEGORIES).withColumns({
        "phase": D.phase(F.col("status")), "province": F.col("province_name"), "year": F.col("year_text").try_cast("int"),
        "sector": F.coalesce("sector_raw", "area", "classification"), "source_url": F.concat(F.lit(url_prefix), F.col("cup")),
        "external_id": F.concat(F.lit("REGISTER-"), F.col("cup")),
        "enrichment_status": F.when(F.col("evidence") & F.coalesce("contractor_name", "rup", "contact_name", "cig").isNotNull(),
                                    "parzialmente arricchito").otherwise("da arricchire"),
    })
    joined = T.lower_text(*[F.col(c) for c in ("title", "description", "sector", "category", "phase", "status", "intervention_type")])
    out = out.withColumn("_joined", joined)
    score = D.commercial_score_v1(
        F.col("_joined"), F.col("category"), F.col("value_eur"), F.col("phase"), F.col("intervention_type"), F.col("client"),
        F.col("contractor_name"), F.col("rup"), F.coalesce("cup", "cig"), F.col("region"), F.col("province"), F.col("municipality"),
        F.col("description"))
    return out.withColumn("commercial_score", score).drop(
        "_joined", "cup_raw", "title_raw", "description_raw", "status_raw", "sector_raw", "province_name", "has_rup", "evidence", "cost", "award_amount")


def first_projects(projects: DataFrame, position: Sequence[str] = ("_file", "_member", "_row")) -> DataFrame:
    """First register row per project, in file order."""
    key = F.coalesce("cup", "external_id", "title")
    return dedupe.first_per_key(projects.withColumn("_key", key), ["_key"], list(position)).drop("_key")


def operational(projects: DataFrame) -> DataFrame:
    """Operational shortlist with the full rule set."""
    text = [c for c in ("title", "description", "category", "sector", "client", "notes") if c in projects.columns]
    staged = with_segments(projects, text)
    macro = D.is_macro(F.col("value_eur"), T.lower_text(*[F.col(c) for c in text]))
    staged = computed_once(staged, {"macro": macro})
    rows = with_operational_score(staged, F.col("macro"))
    band, order = R.labelled_bands(P.NARROW_BANDS, P.LOWEST_BAND)(F.col("value_eur"))
    return topk.shortlist(rows, F.col("macro")).withColumns({"value_band": band, "band_order": order})


@dataclass
class Inputs:
    """Paths of a national run."""

    register: str
    links: str
    contractors: str
    outcomes: str
    branch_map: DataFrame
    branch_position: Sequence[str]
    url_prefix: str = ""
    fallbacks: dict = field(default_factory=lambda: {
        "municipality_overrides": P.MUNICIPALITY_BRANCHES, "province_fallbacks": P.PROVINCE_BRANCHES, "region_fallbacks": P.REGION_BRANCHES})


def _land(df: DataFrame, path: str) -> DataFrame:
    """Write a stage as Parquet and read it back: later stages start from files, not from lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run(spark: SparkSession, inputs: Inputs, out: str) -> dict[str, DataFrame]:
    """Whole pipeline; every returned table is a Parquet table below ``out``."""
    register = files.read_zip(spark, inputs.register, positional=80, delimiter=";")
    projects = _land(first_projects(parse_positional(register, inputs.url_prefix)), f"{out}/projects")
    shortlist = _land(operational(projects), f"{out}/shortlist")

    raw_links = files.read_zip(spark, inputs.links, members="largest", delimiter=";")
    headers = {"cup": P.LINK_PROJECT_HEADERS, "cig": P.TENDER_CODE_HEADERS}
    links = _land(link.link_projects(link.rename_headers(raw_links, headers, ["cup", "cig"]), shortlist).distinct(), f"{out}/links")

    raw_people = files.read_zip(spark, inputs.contractors)
    people = link.rename_headers(raw_people, {"cig": P.TENDER_CODE_HEADERS, **P.CONTRACTOR_HEADERS}, ["cig"])
    tenders = links.select("cig").distinct()
    people = people.withColumn("cig", F.upper(T.blank_to_null(F.col("cig")))).join(tenders, "cig", "left_semi")
    people = _land(people.distinct(), f"{out}/tender_contractor_rows")
    profile = _land(link.contractor_profile(people), f"{out}/tender_contractors")

    raw_outcomes = files.read_zip(spark, inputs.outcomes)
    have = {c.lower(): c for c in raw_outcomes.columns}
    wanted = {"cig": "cig", **P.OUTCOME_COLUMNS}
    outcomes = raw_outcomes.select("_file", "_member", "_row", *[
        (F.col(f"`{have[old.lower()]}`") if old.lower() in have else F.lit(None).cast("string")).alias(new)
        for old, new in wanted.items()])
    outcomes = outcomes.withColumns({
        "cig": F.upper(T.blank_to_null(F.col("cig"))), "award_amount_eur": F.coalesce(V.money(F.col("award_amount_eur")), F.lit(0.0)),
        "award_date": V.parse_date(F.col("award_date"))}).join(tenders, "cig", "left_semi")
    best = link.best_outcome(outcomes, [F.asc("_file"), F.asc("_member"), F.asc("_row")])

    # one row per project and tender with the id of the tender's contractor set; each distinct set is written once
    ids, members = link.contractor_sets(people)
    members = _land(members, f"{out}/contractor_set_members")
    contractor_sets = _land(A.set_texts(members), f"{out}/contractor_sets")
    value = shortlist.select("cup", "title", "primary_segment", "category", "region", "province", "municipality", "client",
                             "value_eur", "source_url")
    enriched = A.with_set(links, ids, ["cig"], "inner").join(best.drop("_file", "_member", "_row"), "cig", "left").join(value, "cup")
    enriched = _land(enriched, f"{out}/enriched")
    consolidated = A.with_ratio(A.valid_awards(enriched))
    relevant, anomalies = A.relevant(consolidated), A.anomalies(consolidated)

    master, raw = master_table(shortlist, relevant, members, inputs, out)
    evidence = link.project_evidence(links, enriched, relevant, anomalies)
    levels = link.evidence_level(master, evidence)
    # the awards of a project in bounded parts: one row per project unless it has very many
    final = _land(A.nested(levels, raw), f"{out}/master")
    return {"projects": projects, "shortlist": shortlist, "links": links, "tender_contractors": profile, "contractor_sets": contractor_sets, "enriched": enriched,
            "relevant": relevant, "anomalies": anomalies, "master": final}


BASE = ("cup", "title", "category", "segment", "region", "province", "municipality", "client", "branch", "branch_candidates",
        "branch_confidence", "branch_assignment_method", "value_eur", "source_url", "id", "source")


def master_table(shortlist: DataFrame, relevant: DataFrame, members: DataFrame, inputs: Inputs, out: str) -> tuple[DataFrame, DataFrame]:
    """Master rows with branch and quality layer, and the landed raw rows with the awards."""
    place = lambda df: geo.assign_branch(df.withColumnRenamed("primary_segment", "segment"), inputs.branch_map,
                                         inputs.branch_position, **inputs.fallbacks)
    award_rows = place(relevant).withColumn("id", F.concat_ws("::", F.lit("AWARD"), "cup", "cig"))
    register_rows = place(shortlist.drop("segment_tags")).withColumn("id", F.concat_ws("::", F.lit("REGISTER"), "cup"))
    raw = _land(A.raw_master(award_rows, register_rows), f"{out}/raw_master")
    grouped = A.group_projects(raw, BASE, members)
    return A.with_quality(grouped.withColumn("code_year", V.code_year(F.col("cup")))), raw


def write_branch_shards(master: DataFrame, path: str, max_mb: float = P.SHARD_MAX_MB) -> DataFrame:
    """Write the master per branch and part; return the shard index."""
    rows = master.withColumn("row_key", F.concat_ws("#", "project_key", "part")).withColumnRenamed("part", "awards_part")
    fan = shards.with_row_bytes(geo.fan_out(rows), rows.columns)
    packed = shards.pack_parts(fan, [("commercial_score", True), ("has_award", True), ("value_eur", True)], "row_key",
                               int(max_mb * shards.MEGABYTE))
    shards.write_shards(packed, path)
    return shards.shard_index(packed)
