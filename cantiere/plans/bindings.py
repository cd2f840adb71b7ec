"""Domain tables built from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.functions import rules as R
from cantiere.functions.text import geo_key, lower_text
from cantiere.functions.values import zero_pad
from cantiere.session import scratch_dir
from cantiere.operators.classify import with_operational_score, with_segments
from cantiere.operators.scale import bounded_tasks

# -- fixed values of the bound preset ----------------------------------------

SEGMENT_TERMS = {
    "Edilizia": ["building"], "Industria": ["machinery"], "Verde": ["automobile"], "Impiantisti": ["household"],
    "Servizi": ["urgent"],
}
SEGMENT_WEIGHTS = {"Edilizia": 30, "Industria": 18, "Verde": 12, "Impiantisti": 10, "Servizi": 5, "Altro": -10}
VALUE_STEPS = (
    (450_000.0, -20), (400_000.0, -10), (350_000.0, 8), (300_000.0, 20), (200_000.0, 30), (100_000.0, 28),
    (50_000.0, 18), (20_000.0, 10),
)
YEAR_STEPS = ((2001, 15), (2000, 12), (1999, 6), (1998, 0), (1997, -8))
COMMERCIAL_STEPS = ((400_000.0, 35), (300_000.0, 30), (200_000.0, 22), (100_000.0, 12), (50_000.0, 6))
HIGH_CATEGORIES = ("BUILDING", "MACHINERY", "HOUSEHOLD")
BANDS = (
    (400_000.0, ">= 400k"), (300_000.0, "300k - 400k"), (200_000.0, "200k - 300k"), (100_000.0, "100k - 200k"),
    (50_000.0, "50k - 100k"), (20_000.0, "20k - 50k"), (10_000.0, "10k - 20k"),
)
LOWEST_BAND = "< 10k"
BAND_ORDER = {label: i + 1 for i, (_, label) in enumerate(BANDS)} | {LOWEST_BAND: len(BANDS) + 1}
MACRO_VALUE, MACRO_TERMS = 400_000.0, ["urgent"]
MIN_AWARD, RATIO_WINDOW = 10_000.0, (0.05, 1.5)
MID_MARKET = (100_000.0, 300_000.0)
QUALITY = dict(
    old_before=1998, recent_from=2001, high_no_award=450_000.0, high=400_000.0,
    bonus=((300_000.0, 8), (150_000.0, 4)), generic_terms=["NOT SPECIFIED", "FURNITURE"], suspicious_terms=["LOW"],
)
AREAS = {"AFRICA": "Sud", "ASIA": "Nord-Est", "EUROPE": "Centro", "AMERICA": "Nord-Ovest"}
SOURCE_URL = "https://register.example/"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    bounded_tasks(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cup_of(key: str):
    return F.concat(F.lit("C"), zero_pad(F.col(key), 9))


def cig_of(key: str):
    return F.concat(F.lit("T"), zero_pad(F.col(key), 9))


def projects(spark: SparkSession, sf: str) -> DataFrame:
    """Project register: orders with customer, nation and region."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    o = table(spark, sf, "orders")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    prefix = R.lookup(F.col("c_custkey") % 4, {0: "COMUNE DI ", 1: "REGIONE ", 2: "PROVINCIA "}, "")
    cup = cup_of("o_orderkey")
    return j.select(
        cup.alias("cup"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.col("c_mktsegment").alias("category"),
        F.col("r_name").alias("region"), F.col("n_name").alias("province"),
        F.concat(F.lit("TOWN_"), F.col("c_custkey") % 50).alias("municipality"),
        F.concat(prefix, F.col("c_name")).alias("client"),
        F.col("o_totalprice").alias("value_eur"),
        R.lookup(F.col("o_orderstatus"), {"F": "CHIUSO", "O": "ATTIVO"}).alias("status"),
        F.year("o_orderdate").alias("year"),
        F.to_date("o_orderdate").alias("decided_on"),
        F.concat(F.lit(SOURCE_URL), cup).alias("source_url"),
    )


def macro_project() -> "F.Column":
    return D.is_macro(F.col("value_eur"), lower_text(F.col("title")), MACRO_VALUE, MACRO_TERMS)


def segmented(df: DataFrame) -> DataFrame:
    """Add segment tags and the primary segment."""
    return with_segments(df, ["title", "category", "client"], "category", SEGMENT_TERMS, SEGMENT_WEIGHTS)


def scored(df: DataFrame, full: bool = True) -> DataFrame:
    """Add the operational score (without year and status terms when not ``full``)."""
    return with_operational_score(df, macro_project(), full, weights=SEGMENT_WEIGHTS, value_steps=VALUE_STEPS, year_steps=YEAR_STEPS)


def with_commercial_score(df: DataFrame) -> DataFrame:
    """Add phase, value band and the national commercial score."""
    band, order = R.labelled_bands(BANDS, LOWEST_BAND)(F.col("value_eur"))
    phase = D.phase(F.col("status"))
    return df.withColumns({
        "phase": phase, "value_band": band, "band_order": order,
        "commercial_score": D.commercial_score_v2(
            F.col("category"), F.col("value_eur"), phase, F.lit(None).cast("string"), F.col("client"), F.col("region"),
            F.col("province"), F.col("municipality"), COMMERCIAL_STEPS, HIGH_CATEGORIES),
    })


def shortlisted(spark: SparkSession, sf: str) -> DataFrame:
    """Operational shortlist of all projects, unordered."""
    from cantiere.operators.topk import shortlist

    return shortlist(scored(segmented(projects(spark, sf))), macro_project())


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Raw project-to-tender links (N:M, with repeats)."""
    return table(spark, sf, "lineitem").select(cup_of("l_orderkey").alias("cup"), cig_of("l_partkey").alias("cig"))


def contractors(spark: SparkSession, sf: str) -> DataFrame:
    """Contractor rows of tenders."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        cig_of("l_partkey").alias("cig"), F.col("s_name").alias("contractor_name"),
        F.col("s_suppkey").cast("string").alias("contractor_tax_code"), F.lit(None).cast("string").alias("contractor_vat"),
        F.col("l_returnflag").alias("contractor_role"),
    )


def published_contractors(spark: SparkSession, sf: str) -> DataFrame:
    """Contractor rows as published: those of every fifth supplier have no name."""
    named = F.col("contractor_tax_code").cast("long") % 5 != 0
    return contractors(spark, sf).withColumn("contractor_name", F.when(named, F.col("contractor_name")))


def awards(spark: SparkSession, sf: str, with_contractor: bool = True) -> DataFrame:
    """Award rows with project, tender, outcome and contractor."""
    li = table(spark, sf, "lineitem")
    cols = dict(
        cup=cup_of("l_orderkey"), cig=cig_of("l_partkey"), award_amount_eur=F.col("l_extendedprice"),
        award_date=F.to_date("l_shipdate"),
        award_result=F.when(F.col("l_linestatus") == "F", "AGGIUDICATA").otherwise("DESERTA"),
        award_result_code=F.col("l_linenumber").cast("string"), award_discount=F.col("l_discount"),
        contractor_role=F.col("l_returnflag"), contractor_tax_code=F.col("l_suppkey").cast("string"),
        quantity=F.col("l_quantity"),
    )
    if with_contractor:
        s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
        li = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        cols |= dict(contractor_name=F.col("s_name"), contractor_vat=F.lit(None).cast("string"))
    return li.select(*[c.alias(n) for n, c in cols.items()])


def award_position() -> list:
    """Total order of the award rows of one project and tender: largest first."""
    return [F.desc("award_amount_eur"), F.asc("award_result_code"), F.asc("contractor_tax_code"),
            F.asc("award_date"), F.asc("contractor_role"), F.asc("quantity"), F.asc("award_discount")]


def consolidated(spark: SparkSession, sf: str) -> DataFrame:
    """Awards consolidated per project and tender, with project value and ratio."""
    return consolidated_sets(spark, sf)[0]


def consolidated_sets(spark: SparkSession, sf: str, **options) -> tuple[DataFrame, DataFrame]:
    """The consolidated awards, and the members of their contractor sets."""
    from cantiere.operators.awards import consolidate

    value = table(spark, sf, "orders").select(cup_of("o_orderkey").alias("cup"), F.col("o_totalprice").alias("value_eur"))
    rows = awards(spark, sf).join(value, "cup")
    return consolidate(rows, award_position(), MIN_AWARD, RATIO_WINDOW, **options)


def branch_map(spark: SparkSession, sf: str) -> DataFrame:
    """Municipality to branch reference: towns with a building, machinery or household customer.

    Towns with several branches are ambiguous; see :func:`cap_branches`.
    """
    from cantiere.operators.geo import municipality_branches

    rows = municipality_branches(cap_places(spark, sf))
    return land(rows.withColumn("province_code", F.lit(None).cast("string")), "branch-map")


def land(df: DataFrame, purpose: str) -> DataFrame:
    """Write a reference table to the shared folder and read it back, so its users do not rebuild it.

    The shuffle files of the job are dropped when it has ended; otherwise they stay until the driver happens to collect garbage.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def offices(spark: SparkSession, sf: str) -> DataFrame:
    """Postal code, branch and place of the customers a branch serves."""
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment").isin(*HIGH_CATEGORIES))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    own = F.concat(F.lit("BR_"), F.col("c_nationkey") % 8)
    branch = F.when(F.col("c_custkey") % 11 == 0, "BR_X").otherwise(own)
    return (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            zero_pad(F.col("c_custkey"), 5).alias("cap"), branch.alias("branch"), F.col("c_custkey").alias("pos"),
            F.concat(F.lit("TOWN_"), F.col("c_custkey") % 50).alias("municipality"),
            F.col("n_name").alias("province"), F.col("r_name").alias("region"),
        )
    )


def cap_places(spark: SparkSession, sf: str) -> DataFrame:
    return offices(spark, sf).withColumns({
        "municipality_norm": geo_key(F.col("municipality")), "province_norm": geo_key(F.col("province")),
    })


FALLBACKS = dict(
    province_fallbacks={"NATION_1": "BR_P", "NATION_9": "BR_Q"}, region_fallbacks={"EUROPE": "BR_E", "ASIA": "BR_A"},
)


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Projects with their branch assignment."""
    from cantiere.operators.geo import assign_places

    return assign_places(projects(spark, sf), branch_map(spark, sf), ["caps"], **FALLBACKS)


def register_as_of(spark: SparkSession, sf: str, day: str) -> DataFrame:
    """Register published on a day: projects decided until then, with the awards shipped until then.

    Closed projects leave the register four years after their decision.
    """
    when = F.lit(day).cast("date")
    p = projects(spark, sf).filter(F.col("decided_on") <= when)
    p = p.filter(~((F.col("status") == "CHIUSO") & (F.add_months("decided_on", 48) < when)) | F.col("status").isNull())
    a = awards(spark, sf, with_contractor=False).filter((F.col("award_date") <= when) & (F.col("award_result") == "AGGIUDICATA"))
    per = a.groupBy("cup").agg(
        F.count(F.lit(1)).alias("awards_count"),
        F.sum(F.col("award_amount_eur").cast("decimal(18,2)")).alias("award_amount_eur"),
        F.min("contractor_tax_code").alias("contractors"), F.max("award_date").alias("award_date"),
    )
    return p.join(per, "cup", "left").withColumns({
        "awards_count": F.coalesce("awards_count", F.lit(0)), "project_value": F.col("value_eur"),
        "branch": F.concat(F.lit("BR_"), F.substring("province", 8, 2)), "record_key": F.col("cup"),
        "cig": F.lit(None).cast("string"), "id": F.lit(None).cast("string"),
    })


PREVIOUS_DAY, CURRENT_DAY = "2000-06-30", "2000-12-31"
