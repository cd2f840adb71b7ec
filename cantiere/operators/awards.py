"""Award consolidation, plausibility split and the nested project master."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import domain as D
from cantiere.functions import presets as P
from cantiere.functions.text import blank_to_null
from cantiere.functions.values import has_text, pipe_text
from cantiere.operators import sets
from cantiere.operators.dedupe import top_per_key
from cantiere.operators.scale import LIST_LIMIT, lists_per_key


def contractor_label(c: Column) -> Column:
    """``name (role)`` of a contractor struct."""
    return F.when(c["role"].isNotNull(), F.concat(c["name"], F.lit(" ("), c["role"], F.lit(")"))).otherwise(c["name"])


def valid_awards(rows: DataFrame, min_award: float = P.MIN_AWARD) -> DataFrame:
    """Awarded rows above the minimum with both codes."""
    awarded = F.contains(F.upper(F.col("award_result")), F.lit(P.AWARDED_WORD))
    return rows.filter(
        awarded & (F.col("award_amount_eur") >= min_award) & has_text(F.col("cup")) & has_text(F.col("cig"))
    )


def with_ratio(df: DataFrame, window: tuple[float, float] = P.RATIO_WINDOW) -> DataFrame:
    """Share of the project value, weight class and plausibility."""
    amount, value = F.col("award_amount_eur"), F.col("value_eur")
    check = D.ratio_check(amount, value, window)
    share = F.coalesce(F.try_divide(amount, value), F.lit(0.0)) * 100
    return df.withColumns({
        "award_share_pct": share, "award_weight": D.award_weight(amount, value),
        "ratio_status": check["status"], "ratio_note": check["note"],
    })


#: What a caller does with an intermediate table: by default nothing, or it writes the table down and reads it back.
Keep = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


def consolidate(rows: DataFrame, position: Sequence[Column], min_award: float = P.MIN_AWARD, window: tuple[float, float] = P.RATIO_WINDOW,
                keep: Keep = as_is) -> tuple[DataFrame, DataFrame]:
    """One row per (project, tender) with the attributes of its first row, and the members of the contractor sets.

    A row carries ``contractor_set`` (an id, NULL without contractors) and ``contractors_count``; each distinct set
    of (name, tax, role) is stored once, as rows ``(set_id, item)``.  Use :func:`award_texts` for the text columns.
    Both come from one table, a row per award and contractor; a caller that uses both can ``keep`` it.
    """
    from cantiere.operators.link import contractor_of

    tagged = keep(sets.tag(valid_awards(rows, min_award), ["cup", "cig"], contractor_of(), position).drop(
        "contractor_name", "contractor_tax_code", "contractor_vat", "contractor_role"  # the item holds them
    ))
    first = tagged.filter(F.col("_rank") == 1).withColumnsRenamed({"set_id": "contractor_set", "n_items": "contractors_count"}).drop("item", "_rank")
    return with_ratio(first, window), sets.members_of(tagged)


def with_set(df: DataFrame, ids: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Attach id and size of each key's contractor set."""
    named = ids.select(*keys, F.col("set_id").alias("contractor_set"), F.col("n_items").alias("contractors_count"))
    return df.join(named, list(keys), how).withColumn("contractors_count", F.coalesce("contractors_count", F.lit(0).cast("long")))


def set_texts(members: DataFrame, limit: int = sets.SET_LIMIT) -> DataFrame:
    """Per set and ``part``: contractor labels and sorted distinct tax codes as pipe lists."""
    taxes = F.array_sort(F.array_distinct(F.array_compact(F.transform("who", lambda c: c["tax"]))))
    return sets.lists(members, "who", limit).select(
        F.col("set_id").alias("contractor_set"), "part", pipe_text(F.transform("who", contractor_label)).alias("contractors"),
        pipe_text(taxes).alias("contractor_tax_codes"))


def award_texts(df: DataFrame, members: DataFrame, limit: int = sets.SET_LIMIT) -> DataFrame:
    """Contractor labels and tax codes of each row as pipe lists; a set above ``limit`` fills several rows (``part``)."""
    texts = df.join(set_texts(members, limit), "contractor_set", "left")
    return texts.withColumn("part", F.coalesce("part", F.lit(0)))


def relevant(consolidated: DataFrame, ordered: bool = False) -> DataFrame:
    out = consolidated.filter(F.col("ratio_status") == "ok")
    if ordered:
        out = out.orderBy(F.desc("award_amount_eur"), F.desc("award_share_pct"), F.desc("value_eur"), "cup", "cig")
    return out


def anomalies(consolidated: DataFrame, ordered: bool = False) -> DataFrame:
    out = consolidated.filter(F.col("ratio_status") != "ok")
    if ordered:
        out = out.orderBy(F.desc(F.abs(F.col("award_share_pct") - 100)), F.desc("award_amount_eur"), "cup", "cig")
    return out


def raw_master(award_rows: DataFrame, register_rows: DataFrame) -> DataFrame:
    """Award rows plus register rows of projects without awards, tagged by source."""
    from cantiere.operators.link import without_awards

    bare = without_awards(register_rows, award_rows)
    tag = lambda df, has: df.withColumns({
        "has_award": F.lit(has),
        "source": F.lit("award" if has else "register"),
        "sources": F.array(F.lit("register"), F.lit("award")) if has else F.array(F.lit("register")),
    })
    return tag(award_rows, True).unionByName(tag(bare, False), allowMissingColumns=True)


def group_projects(raw: DataFrame, base_columns: Sequence[str], members: DataFrame, keep: Keep = as_is) -> DataFrame:
    """Project master: one row per project with its counts, sums and contractor summary.

    ``raw`` has ``cup, id, value_eur, has_award, cig, award_date, award_amount_eur`` and
    ``contractor_set`` (an id; ``members`` has the items).  The base row is the one with the largest value, then the
    smallest tender; of its columns only those that the reader uses are sent.  The rest are aggregates that combine map-side; an
    award has a code or an id.  The awards themselves stay in a table of their own (:func:`award_lists`), see :func:`nested`.
    The names take four exchanges; a caller can ``keep`` them.
    """
    keyed = raw.withColumn("project_key", F.coalesce(F.upper(blank_to_null(F.col("cup"))), F.col("id")))
    value, cig = F.col("value_eur").cast("double"), F.col("cig")
    first = [F.asc_nulls_last(-value), F.asc_nulls_last(cig), F.asc("id")]
    base = top_per_key(keyed, ["project_key"], first).select("project_key", F.struct(*base_columns).alias("_base"))
    totals = keyed.filter("has_award").groupBy("project_key").agg(
        F.count(F.lit(1)).alias("awards_count"),
        F.sum(F.col("award_amount_eur").cast("decimal(18,2)")).cast("double").alias("awards_total_eur"),
        F.max("award_date").alias("last_award_date"),
    )
    base = base.join(totals, "project_key", "left").withColumn("awards_count", F.coalesce("awards_count", F.lit(0).cast("long")))
    # distinct sets, then distinct names, so a project with very many awards is combined before it meets one task
    labels = members.select(F.col("set_id").alias("contractor_set"), contractor_label(F.col("item")).alias("who"))
    names = (
        keyed.filter("has_award").groupBy("project_key", "contractor_set").agg(F.min(F.struct("award_date", "cig")).alias("_when"))
        .join(labels, "contractor_set")
        .groupBy("project_key", "who").agg(F.min(F.struct("_when.award_date", "_when.cig", "who")).alias("_at"))
        .groupBy("project_key").agg(F.count(F.lit(1)).alias("contractors_count"), F.min("_at").alias("_first"))
    )
    more = F.col("contractors_count") - 1
    summary = F.when(more > 0, F.concat(F.col("_first.who"), F.lit(" + altri "), more, F.lit(" OE"))).otherwise(F.col("_first.who"))
    names = keep(names.select("project_key", "contractors_count", summary.alias("contractors_summary")))
    return base.join(names, "project_key", "left").select(
        "project_key", "_base.*", "awards_count", "awards_total_eur", "last_award_date",
        F.coalesce("contractors_count", F.lit(0)).alias("contractors_count"), "contractors_summary",
        (F.col("awards_count") > 0).alias("has_award"),
    )


def nested(master: DataFrame, raw: DataFrame, limit: int = LIST_LIMIT, keep: Keep = as_is) -> DataFrame:
    """Master rows with their awards as sorted arrays: one row per project and ``part``.

    A project with at most ``limit`` awards has one row with part 0; larger ones repeat the
    master columns in every part, and the parts together hold all awards.  The lists can be kept (``keep``).
    """
    keyed = raw.filter("has_award").withColumn("project_key", F.coalesce(F.upper(blank_to_null(F.col("cup"))), F.col("id")))
    # said outright: the join below would say it for some readers of the awards only
    lists = keep(award_lists(keyed.filter(F.col("project_key").isNotNull()), limit).drop("n_items"))
    return master.join(lists, "project_key", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def award_lists(awarded: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Awards per project as sorted arrays in bounded parts (by date, then tender); contractors by the id of their set."""
    entry = F.struct(
        "award_date", "cig", "award_amount_eur", "award_share_pct", "award_weight", "ratio_note", "award_result",
        "contractor_set", "contractors_count",
    )
    return lists_per_key(awarded, ["project_key"], entry, "awards", limit)


def with_quality(master: DataFrame, **options) -> DataFrame:
    """Quality flags, score and reliability of master rows; needs ``code_year`` and ``branch``."""
    q = D.quality(F.col("title"), F.col("code_year"), F.col("has_award"), F.col("awards_count"), F.col("value_eur"),
                  F.col("branch"), **options)
    return master.withColumn("_q", q).select("*", "_q.*").drop("_q")


def master_order() -> list[Column]:
    """Total order of the master: score, evidence, value, key."""
    return [F.desc("commercial_score"), F.desc("has_award"), F.desc_nulls_last("value_eur"), F.asc("project_key")]
