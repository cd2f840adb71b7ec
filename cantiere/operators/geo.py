"""Territory: branch assignment cascade, postal reference, fan-out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions.text import blank_to_null, geo_key, squeeze
from cantiere.functions.values import pipe_list, pipe_text, postal_code
from cantiere.operators.scale import BROADCAST_ROWS, computed_once
from cantiere.session import scratch_dir

ASSIGNMENT = ("branch", "branch_candidates", "branch_confidence", "branch_assignment_method")


def _literal_map(table: Mapping[str, str]) -> Column | None:
    """Lookup dictionary as a literal map; keys normalised like the data."""
    import re

    if not table:
        return None
    norm = lambda k: re.sub(r"[^A-ZÀ-ÖØ-Ý0-9]+", " ", k.upper()).strip()
    entries = {norm(k): v for k, v in table.items()}
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _get(table: Mapping[str, str], key: Column) -> Column:
    m = _literal_map(table)
    return F.lit(None).cast("string") if m is None else F.try_element_at(m, key)


def _landed(dim: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(dim.sparkSession, purpose)
    dim.write.parquet(path)
    return dim.sparkSession.read.schema(dim.schema).parquet(path)


def place_dim(branch_map: DataFrame, position: Sequence[Column | str], aliases: Mapping[str, str] = P.PROVINCE_ALIASES) -> DataFrame:
    """Lookup rows (municipality key, province key or '') -> assignment.

    Province keys are the normalised names and codes with their aliases, the last map row
    wins.  The empty province key holds municipalities whose rows all agree.
    """
    rows = branch_map.filter(
        blank_to_null(F.col("municipality_norm")).isNotNull() & blank_to_null(F.col("province_norm")).isNotNull()
    )
    names = [F.col("province_norm"), geo_key(F.col("province"))]
    if "province_code" in branch_map.columns:
        names.append(geo_key(F.col("province_code")))
    keys = F.array_distinct(F.array_compact(F.array(*names, *[_get(aliases, n) for n in names])))
    at = F.struct(*[F.col(p) if isinstance(p, str) else p for p in position])
    item = F.struct("branch", "branch_candidates", F.col("confidence").alias("branch_confidence"))
    base = rows.select("municipality_norm", keys.alias("keys"), at.alias("at"), item.alias("item"))
    exact = (
        base.select("municipality_norm", F.explode("keys").alias("province_key"), "at", "item")
        .filter(F.col("province_key") != "")
        .groupBy("municipality_norm", "province_key").agg(F.max_by("item", "at").alias("item"))
    )
    signature = F.struct("item.branch", "item.branch_candidates")
    unique = (
        base.groupBy("municipality_norm")
        .agg(F.max_by("item", "at").alias("item"), F.min(signature).alias("lo"), F.max(signature).alias("hi"))
        .filter(F.col("lo").eqNullSafe(F.col("hi")))
        .select("municipality_norm", F.lit("").alias("province_key"), "item")
    )
    return exact.unionByName(unique)


def branch_name_dim(branch_map: DataFrame) -> DataFrame:
    """Branches addressed by their own name; ambiguous and multi-branch cities left out."""
    return (
        branch_map.select(squeeze(F.col("branch")).alias("branch"))
        .filter(~F.col("branch").isin("", P.AMBIGUOUS, P.UNASSIGNED))
        .withColumn("branch_key", geo_key(F.col("branch")))
        .filter(~F.col("branch_key").isin(*P.MULTI_BRANCH_NAMES))
        .groupBy("branch_key").agg(F.min("branch").alias("lo"), F.max("branch").alias("hi"))
        .filter("lo = hi").select("branch_key", F.col("lo").alias("named_branch"))
    )


def assign_branch(df: DataFrame, branch_map: DataFrame, position: Sequence[Column | str],
                  municipality_overrides: Mapping[str, str] | None = None,
                  province_fallbacks: Mapping[str, str] | None = None,
                  region_fallbacks: Mapping[str, str] | None = None,
                  aliases: Mapping[str, str] = P.PROVINCE_ALIASES, max_dim_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Cascade of lookups; earlier steps win.

    1 municipality and province, 2 municipality alone (only without a province), 3 listed
    municipality (same guard), 4 branch named like the province, 5 province, then region
    fallback, else unassigned.  Manual assignments are kept.

    The exploded lookup table is counted first.  Within ``max_dim_rows`` the tables are broadcast and the
    fact table is not shuffled at all; beyond that the cascade runs over the distinct locations
    and the result is joined back once.
    """
    # both lookup tables are computed once and written down; the guard counts what would be broadcast
    dim = _landed(place_dim(branch_map, position, aliases), "places")
    named = _landed(branch_name_dim(branch_map), "branch-names")
    small = dim.limit(max_dim_rows + 1).count() <= max_dim_rows
    where = ["municipality", "province", "region"]
    rules = dict(hint=F.broadcast if small else (lambda d: d), overrides=municipality_overrides or {}, provinces=province_fallbacks or {},
                 regions=region_fallbacks or {}, aliases=aliases)
    have = [c for c in ASSIGNMENT if c in df.columns]
    kept = {c: F.col(c) if c in have else F.lit(None).cast("string") for c in ASSIGNMENT}
    rest = [c for c in df.columns if c not in ASSIGNMENT]
    if small:
        solved = _cascade(df, dim, named, **rules)
    else:
        places = _cascade(df.select(*where).distinct(), dim, named, **rules)
        places = places.select(*[F.col(c).alias(f"_w_{c}") for c in where], "_assigned")
        solved = df.join(places, [df[c].eqNullSafe(F.col(f"_w_{c}")) for c in where], "left")
    manual = (
        F.lower(kept["branch_assignment_method"]).startswith("manual")
        | R.contains_any(F.lower(kept["branch_confidence"]), ["manual", "forzat"])
    ) & blank_to_null(kept["branch"]).isNotNull() & ~kept["branch"].isin(P.UNASSIGNED, "NON_ASSEGNATA")
    manual = F.coalesce(manual, F.lit(False))
    return solved.select(
        *rest, *[F.when(manual, kept[c]).otherwise(F.col(f"_assigned.{c}")).alias(c) for c in ASSIGNMENT]
    )


def assign_places(df: DataFrame, branch_map: DataFrame, position: Sequence[Column | str], max_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """As :func:`assign_branch` for rows without assignments of their own: every distinct location is assigned once."""
    where = ["municipality", "province", "region"]
    places = _landed(assign_branch(df.select(*where).distinct(), branch_map, position, **options), "assigned")
    right = places.select(*[F.col(c).alias(f"_w_{c}") for c in where], *ASSIGNMENT)
    if places.limit(max_rows + 1).count() <= max_rows:
        right = F.broadcast(right)
    return df.join(right, [df[c].eqNullSafe(F.col(f"_w_{c}")) for c in where], "left").drop(*[f"_w_{c}" for c in where])


def _cascade(df: DataFrame, dim: DataFrame, named: DataFrame, hint, overrides, provinces, regions, aliases) -> DataFrame:
    town, prov = geo_key(F.col("municipality")), geo_key(F.col("province"))
    valid = lambda c: F.when(~c.isin(*P.INVALID_PLACES), c)
    d = df.withColumns({"_town": valid(town), "_prov": F.nullif(prov, F.lit("")), "_reg": geo_key(F.col("region"))})
    d = d.withColumn("_alias", _get(aliases, F.col("_prov")))
    no_province = valid(F.col("_prov")).isNull() & valid(F.col("_alias")).isNull()

    # one row per municipality: a municipality has a handful of province keys
    towns = dim.groupBy(F.col("municipality_norm").alias("_in")).agg(
        F.map_from_entries(F.collect_list(F.struct("province_key", "item"))).alias("_places"))

    def name(d: DataFrame, key: Column, out: str) -> DataFrame:
        right = named.select(F.col("branch_key").alias(f"{out}_k"), F.col("named_branch").alias(out))
        right = hint(right)
        usable = F.when(~key.isin(*P.MULTI_BRANCH_PROVINCES), key)
        return d.join(right, usable == right[f"{out}_k"], "left")

    towns = hint(towns)
    d = d.join(towns, d["_town"] == towns["_in"], "left")
    at = lambda key: F.try_element_at("_places", key)
    d = d.withColumns({"_hit1": at(F.coalesce(valid(F.col("_prov")), F.when(no_province, F.lit("")))), "_hit2": at(valid(F.col("_alias")))})
    d = name(d, F.col("_prov"), "_name1")
    d = name(d, F.col("_alias"), "_name2")
    none = F.lit("")
    hit = F.coalesce(F.col("_hit1"), F.col("_hit2"))
    hit_method = F.when(no_province, "fallback_comune_univoco").otherwise("exact_or_alias_province")
    same_name = F.coalesce("_name1", "_name2")
    d = computed_once(d, {
        "_listed": F.when(no_province, _get(overrides, F.col("_town"))),
        "_by_province": F.coalesce(_get(provinces, F.col("_prov")), _get(provinces, F.col("_alias"))),
        "_by_region": _get(regions, F.col("_reg")),
    })
    listed, by_province, by_region = F.col("_listed"), F.col("_by_province"), F.col("_by_region")

    def answer(branch, candidates, confidence, method) -> Column:
        return F.struct(branch.alias("branch"), candidates.alias("branch_candidates"),
                        confidence.alias("branch_confidence"), method.alias("branch_assignment_method"))

    fixed = lambda branch, conf, method: answer(branch, none, F.lit(conf), F.lit(method))
    assigned = (
        F.when(hit.isNotNull(), answer(
            F.coalesce(blank_to_null(hit["branch"]), F.lit(P.UNASSIGNED)),
            F.coalesce(hit["branch_candidates"], none),
            F.coalesce(blank_to_null(hit["branch_confidence"]), hit_method), hit_method))
        .when(listed.isNotNull(), fixed(listed, "territoriale_comune", "fallback_comune_territoriale"))
        .when(same_name.isNotNull(), fixed(same_name, "territoriale_provincia_omonima", "fallback_provincia_omonima_filiale"))
        .when(by_province.isNotNull(), fixed(by_province, "territoriale_provincia", "fallback_provincia_territoriale"))
        .when(by_region.isNotNull(), fixed(by_region, "territoriale_regione", "fallback_regione_territoriale"))
        .otherwise(fixed(F.lit(P.UNASSIGNED), "nessuna", "none"))
    )
    return computed_once(d, {"_assigned": assigned}).select(*df.columns, "_assigned")


def assign_branch_exact(df: DataFrame, branch_map: DataFrame, position: Sequence[Column | str]) -> DataFrame:
    """Simple variant: municipality and province must both match."""
    at = F.struct(*[F.col(p) if isinstance(p, str) else p for p in position])
    dim = branch_map.groupBy(F.col("municipality_norm").alias("_m"), F.col("province_norm").alias("_p")).agg(
        F.max_by(F.struct("branch", "branch_candidates", "confidence"), at).alias("_hit")
    )
    out = df.drop(*ASSIGNMENT).join(
        dim, (geo_key(F.col("municipality")) == F.col("_m")) & (geo_key(F.col("province")) == F.col("_p")), "left"
    )
    return out.withColumns({
        "branch": F.coalesce(blank_to_null(F.col("_hit.branch")), F.lit(P.UNASSIGNED)),
        "branch_candidates": F.coalesce(F.col("_hit.branch_candidates"), F.lit("")),
        "branch_confidence": F.coalesce(F.col("_hit.confidence"), F.lit("nessuna")),
    }).drop("_m", "_p", "_hit")


# -- fan-out -----------------------------------------------------------------


def branch_list(branch: Column, candidates: Column, include_sentinels: bool = True) -> Column:
    """Distinct branches a record belongs to: its own, then its candidates."""
    own = blank_to_null(branch)
    hidden = [P.UNASSIGNED] if include_sentinels else [P.UNASSIGNED, P.AMBIGUOUS]
    values = F.array_distinct(F.concat(F.array_compact(F.array(F.when(~own.isin(*hidden), own))), pipe_list(candidates)))
    if include_sentinels:
        values = F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(P.UNASSIGNED)))
    return values


def fan_out(df: DataFrame, include_sentinels: bool = True, name: str = "listed_branch") -> DataFrame:
    """One row per branch a record is listed under."""
    return df.withColumn(name, F.explode(branch_list(F.col("branch"), F.col("branch_candidates"), include_sentinels)))


# -- postal reference --------------------------------------------------------


def cap_branch(rows: DataFrame, position: Sequence[Column | str]) -> DataFrame:
    """Postal code to branch: the last row of a code wins; ``branches`` counts the distinct ones."""
    at = F.struct(*[F.col(p) if isinstance(p, str) else p for p in position])
    clean = rows.select(postal_code(F.col("cap")).alias("cap"), blank_to_null(F.col("branch")).alias("branch"), at.alias("_at"))
    return (
        clean.filter("cap is not null and branch is not null").groupBy("cap")
        .agg(F.max_by("branch", "_at").alias("branch"), (F.min("branch") != F.max("branch")).alias("conflict"))
    )


def resolve_places(caps: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places of every code, one row per comma-separated name; codes without a place)."""
    names = F.filter(F.transform(F.split(F.col("place_name"), ","), squeeze), lambda x: x != "")
    joined = caps.join(places.filter(F.size(names) > 0), "cap", "inner")
    found = joined.withColumn("municipality", F.explode(names)).withColumns({
        "municipality_norm": geo_key(F.col("municipality")), "province_norm": geo_key(F.col("province")),
    }).drop("place_name")
    missing = caps.join(places.filter(F.size(names) > 0), "cap", "left_anti")
    return found, missing


def municipality_branches(cap_places: DataFrame) -> DataFrame:
    """Municipality to branch: the single branch, or the ambiguous sentinel with candidates.

    The lists are bounded by the number of branches and of five-digit postal codes, and
    combined map-side.
    """
    keys = ["municipality_norm", "province_norm"]
    base = cap_places.groupBy(*keys).agg(
        F.array_sort(F.collect_set("branch")).alias("branches"),
        F.max("municipality").alias("municipality"), F.max("province").alias("province"),
        F.max("region").alias("region"), F.array_sort(F.collect_set("cap")).alias("cap_list"),
    )
    single = F.size("branches") == 1
    return base.select(
        *keys, "municipality", "province", "region",
        F.when(single, F.get("branches", F.lit(0))).otherwise(F.lit(P.AMBIGUOUS)).alias("branch"),
        pipe_text(F.col("branches")).alias("branch_candidates"),
        F.when(single, "alta").otherwise("bassa").alias("confidence"),
        pipe_text(F.col("cap_list")).alias("caps"),
    )


def municipality_issues(branches: DataFrame) -> DataFrame:
    return branches.filter(F.col("branch") == P.AMBIGUOUS).select(
        "municipality", "province", "region", "caps", "branch_candidates",
        F.lit("Comune/CAP associato a più filiali").alias("issue"),
    )


def caps_per_branch(caps: DataFrame) -> DataFrame:
    return caps.groupBy("branch").agg(F.count(F.lit(1)).alias("cap_count")).orderBy(F.desc("cap_count"), "branch")


def territory(branch_map: DataFrame) -> DataFrame:
    """Branch to distinct places; ambiguous rows count for every candidate."""
    own = blank_to_null(F.col("branch"))
    listed = F.when(own == P.AMBIGUOUS, pipe_list(F.col("branch_candidates"))).when(
        own != P.UNASSIGNED, F.array(own)
    )
    return branch_map.select(F.explode(listed).alias("branch"), "region", "province", "municipality").distinct()


def directory(places: DataFrame, area: Column, shown: int = 12, areas: Sequence[str] = P.AREA_ORDER) -> DataFrame:
    """Branch directory: areas, regions, provinces (first ``shown`` then ``+n``), place count.

    Sorted by area in the order of ``areas`` (others last) and branch name.
    """
    flat = places.groupBy("branch").agg(
        F.array_sort(F.collect_set(blank_to_null(F.col("region")))).alias("regions"),
        F.array_sort(F.collect_set(blank_to_null(F.col("province")))).alias("provinces"),
        F.count_distinct(blank_to_null(F.col("municipality"))).alias("municipalities_count"),
        F.count(F.lit(1)).alias("territory_count"),
    )
    extra = F.size("provinces") - shown
    text = F.array_join(F.slice("provinces", 1, shown), ", ")
    return flat.select(
        "branch", area.alias("area"), F.array_join("regions", ", ").alias("regions"),
        F.when(extra > 0, F.concat(text, F.lit(" +"), extra)).otherwise(text).alias("provinces"),
        "municipalities_count", "territory_count",
    ).orderBy(F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(a) for a in areas]), F.col("area")), F.lit(0).cast("long")), F.lit(99).cast("long")),
              F.lower("branch"), "branch")
