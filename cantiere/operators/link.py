"""Code linkage: project code (cup) to tender code (cig), tender to contractor and outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.functions.text import blank_to_null, find_column, first_alias
from cantiere.functions.values import has_text, parse_date, percentage, pipe_list, pipe_text
from cantiere.operators import sets
from cantiere.operators.dedupe import top_per_key
from cantiere.operators.scale import LIST_LIMIT, computed_once, lists_per_key


def link_projects(links: DataFrame, targets: DataFrame, cup: str = "cup", cig: str = "cig") -> DataFrame:
    """Links whose project is a target; codes upper-cased, blank tender codes dropped."""
    norm = lambda c: F.upper(blank_to_null(F.col(c)))
    wanted = targets.select(norm(cup).alias("cup")).filter(F.col("cup").isNotNull())
    # both codes are needed by the filter, the join and the result
    codes = computed_once(links.select(F.col(cup).alias("cup"), F.col(cig).alias("cig")), {"cup": norm("cup"), "cig": norm("cig")})
    return (
        codes.filter(F.col("cup").isNotNull() & F.col("cig").isNotNull())
        .join(wanted, "cup", "left_semi")
    )


def link_projects_raw(links: DataFrame, targets: DataFrame, source: str | None = None, cup: str = "cup",
                      cig: str = "cig") -> DataFrame:
    """Regional variant: case-sensitive, blank tender codes kept, source file kept."""
    cols = [F.trim(F.col(cup)).alias("cup"), F.coalesce(F.trim(F.col(cig)), F.lit("")).alias("cig")]
    if source:
        cols.append(F.col(source).alias("source_dataset"))
    wanted = targets.select(blank_to_null(F.col(cup)).alias("cup"))
    return links.select(*cols).join(wanted, "cup", "left_semi")


def rename_headers(df: DataFrame, headers: Mapping[str, Sequence[str]], required: Sequence[str] = (),
                   partial: bool = True) -> DataFrame:
    """Select the columns found for each candidate list; absent ones become NULL."""
    cols = []
    for name, candidates in headers.items():
        found = find_column(df.columns, candidates, partial)
        if found is None and name in required:
            raise ValueError(f"no column for {name}: tried {list(candidates)} in {df.columns}")
        cols.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*cols)


def tender_sets(links: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Per project: sorted tender codes in bounded parts; ``cig_count`` is the project's total."""
    return lists_per_key(links, ["cup"], F.col("cig"), "cigs", limit).withColumnRenamed("n_items", "cig_count")


def project_sets(links: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Per tender: sorted project codes in bounded parts; ``cup_count`` is the tender's total."""
    return lists_per_key(links, ["cig"], F.col("cup"), "cups", limit).withColumnRenamed("n_items", "cup_count")


def metadata(df: DataFrame) -> DataFrame:
    """Shortlist row in the metadata shape used by the tender targets."""
    value = first_alias(df, "value_eur", "project_value", "value")
    cols = {
        "title": first_alias(df, "title"), "client": first_alias(df, "client"),
        "primary_segment": first_alias(df, "primary_segment", "segment"),
        "segment": first_alias(df, "segment", "primary_segment"),
        "region": first_alias(df, "region"), "province": first_alias(df, "province"),
        "municipality": first_alias(df, "municipality"), "value_eur": value, "project_value": value,
        "branch": first_alias(df, "branch"), "source_url": first_alias(df, "source_url", "url"),
        "category": first_alias(df, "category"), "operational_score": first_alias(df, "operational_score", "score"),
    }
    keep = [F.upper(first_alias(df, "cup")).alias("cup")]
    out = df.select(*keep, *[c.alias(n) for n, c in cols.items()], *[c for c in df.columns if c.startswith("_pos")])
    return out.withColumn("completeness", D.completeness([F.col(f) for f in P.METADATA_FIELDS]))


def richest_metadata(meta: DataFrame, position: Sequence[Column]) -> DataFrame:
    """Most complete row per project, first seen wins ties."""
    return top_per_key(meta.filter(F.col("cup").isNotNull()), ["cup"], [F.desc("completeness"), *position])


def representative_project(links: DataFrame, meta: DataFrame) -> DataFrame:
    """Per tender: the project with the richest metadata, smallest code on ties.

    The choice is one aggregate over (score, code), so hot tenders combine map-side.
    """
    scored = links.select("cup", "cig").join(meta.select("cup", "completeness"), "cup", "left")
    # one comparable struct: higher completeness first, then the smaller code
    rank = F.struct(-F.coalesce(F.col("completeness"), F.lit(0)), F.col("cup"))
    best = scored.groupBy("cig").agg(F.min(rank).alias("_best"))
    return best.select("cig", F.col("_best.cup").alias("cup"))


def coverage(targets: DataFrame, links: DataFrame, matched: DataFrame) -> DataFrame:
    """One-row summary of the project-to-tender match."""
    # one tall table and one aggregate; the raw side enters as a single counted row
    none = F.lit(None).cast("string")
    raw = links.agg(F.count(F.lit(1)).alias("n")).select(F.lit("raw").alias("kind"), none.alias("cup"), none.alias("cig"), "n")
    rows = lambda df, kind, cig: df.select(F.lit(kind).alias("kind"), "cup", cig.alias("cig"), F.lit(0).cast("long").alias("n"))
    tall = raw.unionByName(rows(targets, "target", none)).unionByName(rows(matched, "match", F.col("cig")))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    one = tall.agg(
        F.count_distinct(of("target", "cup")).alias("target_cups"),
        F.sum("n").alias("rows_scanned"),
        F.count_if(F.col("kind") == "match").alias("match_rows"),
        F.count_distinct(of("match", "cup")).alias("matched_target_cups"),
        F.count_distinct(of("match", "cig")).alias("matched_unique_cigs"),
    )
    return one.withColumns({
        "unmatched_target_cups": F.col("target_cups") - F.col("matched_target_cups"),
        "coverage_target_cups_pct": percentage(F.col("matched_target_cups"), F.col("target_cups")),
        "avg_cig_per_matched_cup": F.coalesce(
            F.try_divide(F.col("match_rows").cast("double"), F.col("matched_target_cups").cast("double")), F.lit(0.0)
        ),
    })


def union_targets(csv_targets: DataFrame, shard_targets: DataFrame, stale_share: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Distinct union of two target lists, and a one-row staleness check of the first."""
    code = lambda df: df.select(F.upper(blank_to_null(F.col("cup"))).alias("cup")).filter("cup is not null")
    a, b = code(csv_targets), code(shard_targets)
    tagged = a.withColumn("_side", F.lit("csv")).unionByName(b.withColumn("_side", F.lit("shard")))
    check = (
        tagged.distinct()
        .agg(F.count_if(F.col("_side") == "csv").alias("csv_cups"),
             F.count_if(F.col("_side") == "shard").alias("shard_cups"))
        .withColumn("stale", (F.col("csv_cups") > 0) & (F.col("shard_cups") > 0)
                    & (F.col("csv_cups") < F.col("shard_cups") * F.lit(stale_share)))
    )
    return a.union(b).distinct(), check


def missing_targets(targets: DataFrame, matched: DataFrame) -> DataFrame:
    """Targets without any link."""
    return targets.select("cup").distinct().join(matched.select("cup"), "cup", "left_anti")


# -- contractors and outcomes ------------------------------------------------


def contractor_matches(contractors: DataFrame, tender_targets: DataFrame) -> DataFrame:
    """Contractor rows of target tenders, with the tender's chosen project and its columns.

    ``tender_targets`` has one row per tender, so the row count is that of the matches.
    """
    return contractors.join(tender_targets, "cig", "inner")


def contractor_of() -> Column:
    """Contractor struct (name, tax, role) of a contractor row; NULL without a name."""
    who = F.struct(
        F.col("contractor_name").alias("name"),
        F.coalesce(blank_to_null(F.col("contractor_tax_code")), blank_to_null(F.col("contractor_vat"))).alias("tax"),
        blank_to_null(F.col("contractor_role")).alias("role"),
    )
    return F.when(has_text(F.col("contractor_name")), who)


def _named(contractors: DataFrame) -> DataFrame:
    """Contractor rows of a tender, blank names as NULL.

    A code with text is not NULL: said outright, since joins would say it for some readers only, and readers with different
    conditions each compute the rows again.
    """
    kept = contractors.filter(has_text(F.col("cig")) & F.col("cig").isNotNull())
    return kept.withColumn("contractor_name", blank_to_null(F.col("contractor_name")))


def contractor_profile(contractors: DataFrame, limit: int = 1_000) -> DataFrame:
    """Per tender: distinct contractors as structs (name, tax, role), in bounded parts.

    ``n_contractors`` is the tender's total in every part; a tender is never without a part.
    """
    named = _named(contractors)
    return lists_per_key(named, ["cig"], contractor_of(), "contractors", limit).withColumnRenamed("n_items", "n_contractors")


def contractor_sets(contractors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per tender: the id and size of its set of distinct contractors; and the members of each distinct set, once."""
    named = _named(contractors)
    return sets.intern(named, ["cig"], contractor_of())


def contractors_by_project(profile: DataFrame, links: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per (project, tender) with the tender's contractors and project metadata.

    Tenders without project are kept once.  The contractor list stays nested: exploding
    contractor rows against project rows of a shared tender is left to the reader of
    the table.  The link side may be skewed, so it is the streamed side of an inner join.  The pairs
    get their metadata first: a list is sent once per tender, not once per pair.
    """
    pairs = links.select("cup", "cig").distinct()
    linked = pairs.join(meta, "cup", "left").join(profile, "cig", "inner")
    # not an anti join, which would be moved below the lists and compute them a second time; counts, since the pairs of
    # a mere distinct would be computed a second time
    known = pairs.groupBy("cig").agg(F.count(F.lit(1)).alias("_links"))
    unlinked = profile.join(known, "cig", "left").filter(F.col("_links").isNull()).drop("_links")
    return linked.unionByName(unlinked, allowMissingColumns=True)


def best_outcome(outcomes: DataFrame, position: Sequence[Column]) -> DataFrame:
    """One outcome per tender: awarded, code 1, positive amount, latest year; first wins ties.

    Expects ``cig, award_result, award_result_code, award_amount_eur, award_date``.
    """
    date = F.col("award_date")
    if outcomes.schema["award_date"].dataType.typeName() == "string":
        date = parse_date(date)
    preference = D.award_preference(F.col("award_result"), F.col("award_result_code"), F.col("award_amount_eur"), date)
    return top_per_key(
        outcomes.filter(has_text(F.col("cig"))).withColumn("preference", preference),
        ["cig"], [F.desc("preference"), *position],
    )


def with_outcome(rows: DataFrame, best: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Attach the chosen outcome; rows without one keep NULLs."""
    cols = list(columns or [c for c in best.columns if c not in rows.columns])
    return rows.join(best.select("cig", *cols), "cig", "left")


def without_awards(register: DataFrame, awards: DataFrame) -> DataFrame:
    """Register rows whose project has no award; rows without a code are kept."""
    have = awards.select(F.upper(blank_to_null(F.col("cup"))).alias("_cup")).filter("_cup is not null")
    return register.join(have, F.upper(blank_to_null(F.col("cup"))) == F.col("_cup"), "left_anti")


def strip_awards(df: DataFrame, text_columns: Sequence[str] = (
        "contractors", "contractor_tax_codes", "contractors_summary", "award_date", "award_result",
        "award_amount_eur", "award_share_pct", "award_weight", "ratio_note")) -> DataFrame:
    """Blank the award columns of an enriched table that is used as register input again."""
    present = {c: F.lit(None).cast(df.schema[c].dataType) for c in text_columns if c in df.columns}
    if "has_award" in df.columns:
        present["has_award"] = F.lit(False)
    if "awards_count" in df.columns:
        present["awards_count"] = F.lit(0).cast(df.schema["awards_count"].dataType)
    if "awards" in df.columns:
        present["awards"] = F.array().cast(df.schema["awards"].dataType)
    return df.withColumns(present)


# -- evidence ----------------------------------------------------------------


def project_evidence(links: DataFrame, enriched: DataFrame, relevant: DataFrame, anomalies: DataFrame,
                     min_award: float = P.MIN_AWARD, window: tuple[float, float] = P.RATIO_WINDOW) -> DataFrame:
    """Evidence counters per project from the four linkage tables.

    ``enriched`` holds ``cup, cig, award_result, award_amount_eur, value_eur``.  Review
    and small counters count distinct tenders.  The four sources become one tall table
    with a single exchange on the project code, aggregated map-side first.
    """
    amount = F.coalesce(F.col("award_amount_eur"), F.lit(0.0))
    awarded = F.coalesce(F.contains(F.upper(F.col("award_result")), F.lit(P.AWARDED_WORD)), F.lit(False))
    plausible = D.ratio_check(amount, F.col("value_eur"), window)["status"] == "ok"
    small = awarded & (amount > 0) & (amount < min_award)
    review = ~awarded | (amount <= 0) | ((amount >= min_award) & ~plausible)
    mark = lambda df, kind: df.select("cup", "cig", F.lit(kind).alias("kind"))
    both = F.when(small, F.array(F.lit("enriched"), F.lit("small"))).when(
        review, F.array(F.lit("enriched"), F.lit("review"))).otherwise(F.array(F.lit("enriched")))
    tall = (
        mark(links, "match")
        .unionByName(enriched.select("cup", "cig", F.explode(both).alias("kind")))
        .unionByName(mark(relevant, "confirmed"))
        .unionByName(mark(anomalies, "review"))
        .filter(F.col("cup").isNotNull() & F.col("cig").isNotNull())
        .distinct()
    )
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return tall.groupBy("cup").agg(
        n("match").alias("match_cig_count"), n("enriched").alias("enriched_cig_count"),
        n("confirmed").alias("confirmed_awards_count"), n("small").alias("small_awards_count"),
        n("review").alias("review_awards_count"),
    )


def evidence_level(master: DataFrame, evidence: DataFrame) -> DataFrame:
    """Master rows with counters and the exclusive level."""
    counters = [c for c in evidence.columns if c != "cup"]
    joined = master.join(evidence, "cup", "left").fillna(0, counters)
    level = (
        F.when(F.col("confirmed_awards_count") > 0, "confirmed")
        .when(F.col("small_awards_count") > 0, "small")
        .when((F.col("review_awards_count") > 0) | (F.col("enriched_cig_count") > 0), "review")
        .when(F.col("match_cig_count") > 0, "technical")
        .otherwise("none")
    )
    return joined.withColumn("evidence_level", level)


def evidence_funnel(levels: DataFrame) -> DataFrame:
    """Cumulative funnel and exclusive levels as (section, name, count, pct)."""
    one = levels.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("match_cig_count") > 0).alias("funnel:technical_match"),
        F.count_if(F.col("enriched_cig_count") > 0).alias("funnel:enriched"),
        F.count_if(F.col("confirmed_awards_count") > 0).alias("funnel:confirmed"),
        *[F.count_if(F.col("evidence_level") == lv).alias(f"level:{lv}") for lv in P.EVIDENCE_LEVELS],
    )
    names = [c for c in one.columns if c != "total"]
    tall = one.unpivot(["total"], names, "_name", "count")
    piece = F.split(F.col("_name"), ":")
    return tall.select(F.get(piece, F.lit(0)).alias("section"), F.get(piece, F.lit(1)).alias("name"), "count",
                       percentage(F.col("count"), F.col("total")).alias("pct"))


def list_text(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as ``A | B`` text for delimited outputs."""
    return df.withColumns({c: pipe_text(F.col(c)) for c in columns})
