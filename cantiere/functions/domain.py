"""Procurement columns: classification, predicates and scores on top of the rule primitives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions.text import blank_to_null, squeeze
from cantiere.functions.values import has_text

# -- predicates and simple classes -------------------------------------------


def clean_status(c: Column) -> Column:
    """Upper-case status, NULL for geographic words and for texts without a status word."""
    v = F.upper(squeeze(c))
    return F.when(~v.isin(*P.NOT_A_STATUS) & R.contains_any(v, P.STATUS_WORDS), v)


def phase(status: Column | R.Matched) -> Column:
    text = status if isinstance(status, R.Matched) else F.upper(squeeze(status))
    return R.first_match(text, P.PHASES, P.DEFAULT_PHASE)


def category(text: Column, rules: R.Rules = P.NATIONAL_CATEGORIES) -> Column:
    return R.first_match(text, rules, P.OTHER)


def intervention_type(text: Column) -> Column:
    return R.first_match(text, P.INTERVENTION_TYPES)


def is_noise(text: Column, terms: Sequence[str] = P.NATIONAL_NOISE) -> Column:
    return R.contains_any(text, terms)


def is_candidate(text: Column) -> Column:
    """National candidate rule."""
    return R.contains_any(text, P.NATIONAL_CANDIDATES)


def is_regional_candidate(text: Column) -> Column:
    """Regional rule: not a light project, and a known category or a generic work word."""
    return ~R.contains_any(text, P.LIGHT_PROJECT_NOISE) & (
        (category(text, P.CATEGORIES) != P.OTHER) | R.contains_any(text, P.GENERIC_WORK_WORDS)
    )


def is_live(status: Column, phase_: Column) -> Column:
    dead = [R.contains_any(F.upper(squeeze(c)), P.DEAD_STATUS_WORDS) for c in (status, phase_)]
    return ~R.any_of(dead)


def is_local_client(client: Column) -> Column:
    return R.contains_any(F.upper(squeeze(client)), P.LOCAL_CLIENT_MARKERS)


def is_macro(value: Column, text: Column, minimum: float = P.MACRO_VALUE,
             terms: Sequence[str] = P.MACRO_TERMS) -> Column:
    return F.coalesce(value >= minimum, F.lit(False)) & R.contains_any(text, terms)


# -- segments ----------------------------------------------------------------


def segments(text: Column, category_: Column, terms: R.Rules = P.SEGMENT_TERMS,
             weights: Mapping[str, int] = P.SEGMENT_WEIGHTS, reduced: bool = False) -> Column:
    """Ranked segment array from text terms and category rules.

    ``text`` and ``category_`` are lower-case plain columns (see ``with_segments``).  The full rule
    set picks one label for the environment category by its text and falls back to building works for
    urban redevelopment without other hits; the reduced set adds both unconditionally.
    """
    flags = {label: R.contains_any(text, words) for label, words in terms.items()}
    cat = F.coalesce(category_, F.lit(""))

    def add(label: str, condition: Column) -> None:
        flags[label] = condition | flags[label] if label in flags else condition

    for part, label in P.CATEGORY_SEGMENTS_CONTAINED.items():
        add(label, F.contains(cat, F.lit(part)))
    environment = F.contains(cat, F.lit(P.ENVIRONMENT_CATEGORY))
    urban = F.contains(cat, F.lit(P.URBAN_CATEGORY))
    if reduced:
        add("Impiantisti sottoservizi", environment)
        contained = [c for c in (*P.BUILDING_CATEGORIES, P.URBAN_CATEGORY) if c != "sanità / rsa"]
        add("Edilizia", R.contains_any(cat, contained) | (cat == "sanità / rsa"))
        return R.ranked_labels(flags, weights, P.OTHER)
    utility = R.contains_any(text, P.ENVIRONMENT_UTILITY_TERMS)
    add("Impiantisti sottoservizi", environment & utility)
    add("Bonifiche e gestione rifiuti", environment & ~utility)
    add("Edilizia", cat.isin(*P.BUILDING_CATEGORIES))
    return R.ranked_labels(flags, weights, F.when(urban, F.lit("Edilizia")).otherwise(F.lit(P.OTHER)))


# -- scores ------------------------------------------------------------------


def commercial_score_v1(text: Column, category_: Column, value: Column, phase_: Column, intervention: Column,
                        client: Column, contractor: Column, designer: Column, project_code: Column,
                        region: Column, province: Column, municipality: Column, description: Column,
                        value_steps=P.COMMERCIAL_VALUE_STEPS, high_categories=P.HIGH_CATEGORIES) -> Column:
    """Register score; ``text`` is the lower-case concatenation of the descriptive fields."""
    valued = F.coalesce(value, F.lit(0.0)) != 0.0
    return R.score(
        R.points(category_.isin(*high_categories), 25),
        F.when(valued, R.steps(value, value_steps, P.COMMERCIAL_VALUE_BELOW)).otherwise(F.lit(0)),
        R.points(R.contains_any(F.lower(phase_), P.GOOD_PHASES), 20),
        R.points(has_text(intervention), 10),
        R.points(has_text(client), 8),
        R.points(has_text(contractor), 10),
        R.points(has_text(designer), 8),
        R.points(has_text(project_code), 5),
        R.points(has_text(region), 3), R.points(has_text(province), 3), R.points(has_text(municipality), 4),
        R.points(F.contains(text, F.lit("lavori pubblici")), 10),
        R.points(R.contains_any(text, ["contributo", "incentivo", "voucher"]), -20),
        R.points(has_text(description), 0, -10),
    )


def commercial_score_v2(category_: Column, value: Column, phase_: Column, intervention: Column, client: Column,
                        region: Column, province: Column, municipality: Column,
                        value_steps=P.COMMERCIAL_VALUE_STEPS, high_categories=P.HIGH_CATEGORIES) -> Column:
    """National score: a missing value also costs points and any phase counts."""
    return R.score(
        R.points(category_.isin(*high_categories), 25),
        R.steps(F.coalesce(value, F.lit(0.0)), value_steps, P.COMMERCIAL_VALUE_BELOW),
        R.points(has_text(phase_), 15),
        R.points(has_text(intervention), 10),
        R.points(has_text(client), 8),
        R.points(has_text(region), 3), R.points(has_text(province), 3), R.points(has_text(municipality), 4),
    )


def client_points(client: Column) -> Column:
    """Points by kind of public client; ``client`` is an upper-case plain column."""
    tiers = (
        F.when(client.startswith("COMUNE"), 15)
        .when(R.contains_any(client, ["PROVINCIA", "CITTA", "CITTÀ"]), 12)
        .when(R.contains_any(client, ["REGIONE", "AZIENDA USL", "ASL", "AZIENDA OSPEDALIERA"]), 10)
        .otherwise(8)
    )
    return F.when(R.contains_any(client, P.LOCAL_CLIENT_MARKERS), tiers).otherwise(0)


def operational_score(primary: Column, value: Column, client: Column, place: Column, category_: Column,
                      macro: Column, project_code: Column, source_url: Column, year: Column | None = None,
                      status: Column | None = None, weights: Mapping[str, int] = P.SEGMENT_WEIGHTS,
                      value_steps=P.OPERATIONAL_VALUE_STEPS, year_steps=P.YEAR_STEPS) -> Column:
    """Sales score of a project.  Without ``year`` and ``status`` this is the reduced variant.

    ``client``, ``place`` and ``status`` are upper-case plain columns (see ``with_operational_score``).
    """
    terms = [
        R.lookup(primary, dict(weights), -10),
        R.steps(F.coalesce(value, F.lit(0.0)), value_steps, P.OPERATIONAL_VALUE_BELOW),
        client_points(client),
        R.points(F.coalesce(~place.isin("", *P.GENERIC_PLACES), F.lit(False)), 10, -12),
        R.points(category_ == P.OTHER, -10),
        R.points(macro, -25),
        R.points(has_text(project_code), 2),
        R.points(has_text(source_url), 2),
    ]
    if year is not None:
        terms.append(F.when(year.isNull(), 0).otherwise(R.steps(year, year_steps, P.YEAR_BELOW)))
    if status is not None:
        terms.append(
            F.when(R.contains_any(status, ["CHIUSO", "REVOCATO", "CANCELLATO"]), -40)
            .when(R.contains_any(status, ["ATTIVO"]), 8).otherwise(0)
        )
    return R.score(*terms)


# -- awards ------------------------------------------------------------------


def award_weight(amount: Column, value: Column) -> Column:
    usable = (F.coalesce(amount, F.lit(0.0)) != 0) & (F.coalesce(value, F.lit(0.0)) != 0)
    ratio = F.try_divide(amount, value)
    return F.when(usable, R.steps(ratio, P.AWARD_WEIGHTS, P.AWARD_WEIGHT_BELOW)).otherwise(P.AWARD_WEIGHT_UNKNOWN)


def ratio_check(amount: Column, value: Column, window: tuple[float, float] = P.RATIO_WINDOW) -> Column:
    """Struct (status, note): is the award amount plausible for the project value?"""
    low, high = window
    ratio = F.try_divide(amount, value)
    reason = (
        F.when(F.coalesce(value, F.lit(0.0)) <= 0, "missing")
        .when(ratio > high, "high").when(ratio < low, "low").otherwise("ok")
    )
    return F.struct(
        F.when(reason == "ok", "ok").otherwise("anomalia").alias("status"),
        R.lookup(reason, P.RATIO_NOTES).alias("note"),
    )


def award_preference(result: Column, result_code: Column, amount: Column, date: Column) -> Column:
    """Score used to choose one outcome per tender."""
    return (
        R.points(F.contains(F.upper(squeeze(result)), F.lit(P.AWARDED_WORD)), 100)
        + R.points(squeeze(result_code) == "1", 100)
        + R.points(amount > 0, 30)
        + F.coalesce(F.year(date), F.lit(0))
    )


def completeness(cols: Sequence[Column]) -> Column:
    """Number of non-blank columns."""
    total = F.lit(0)
    for c in cols:
        total = total + R.points(has_text(c), 1)
    return total


def contractor_present(flat: Sequence[Column], awards: Column | None = None,
                       award_fields: Sequence[str] = ("contractors", "contractor_tax_codes")) -> Column:
    """A contractor is named in a flat field or in any nested award."""
    found = R.any_of([has_text(c) for c in flat])
    if awards is not None:
        found = found | F.coalesce(
            F.exists(awards, lambda a: R.any_of([has_text(a[f]) for f in award_fields])), F.lit(False)
        )
    return found


# -- quality -----------------------------------------------------------------


def quality(title: Column, code_year: Column, has_award: Column, awards_count: Column, value: Column,
            branch: Column, old_before: int = 2015, recent_from: int = 2023,
            high_no_award: float = 150_000_000.0, high: float = 100_000_000.0,
            bonus: Sequence[tuple[float, int]] = ((50_000_000.0, 8), (10_000_000.0, 4)),
            generic_terms: Sequence[str] = P.GENERIC_TITLE_TERMS,
            suspicious_terms: Sequence[str] = P.SUSPICIOUS_TITLE_TERMS) -> Column:
    """Struct (quality_flags, commercial_score, data_reliability) of a master row."""
    t = F.upper(squeeze(title))
    v = F.coalesce(value, F.lit(0.0))
    awarded = F.coalesce(has_award, F.lit(False))
    old = F.coalesce(code_year < old_before, F.lit(False))
    n = F.coalesce(awards_count.cast("int"), F.lit(0))
    found = {
        "NO_ANAC_MATCH": ~awarded,
        "OLD_CUP": old,
        "CUP_YEAR_UNKNOWN": code_year.isNull(),
        "GENERIC_OR_MAINTENANCE_TITLE": R.contains_any(t, generic_terms),
        "HIGH_VALUE_WITHOUT_ANAC": (v >= high_no_award) & ~awarded,
        "OLD_HIGH_VALUE": (v >= high) & old,
        "VALUE_SUSPICIOUS": (v >= high) & R.contains_any(t, suspicious_terms),
        "BRANCH_MISSING": blank_to_null(branch).isNull(),
        "BRANCH_AMBIGUOUS": F.coalesce(branch == P.AMBIGUOUS, F.lit(False)),
        "BRANCH_NOT_ASSIGNED": F.coalesce(branch == P.UNASSIGNED, F.lit(False)),
    }
    total = R.score(
        F.lit(50),
        R.points(awarded, 25),
        F.when(n > 1, F.least(F.lit(12), n * 2)).otherwise(0),
        R.points(code_year >= recent_from, 8),
        R.steps(v, bonus, 0),
        *[R.points(found[name], cost) for name, cost in P.QUALITY_PENALTIES.items()],
    )
    return F.struct(
        R.flags({name: found[name] for name in P.QUALITY_PENALTIES}).alias("quality_flags"),
        total.alias("commercial_score"),
        R.steps(total, ((75, "ALTA"), (50, "MEDIA")), "BASSA").alias("data_reliability"),
    )
