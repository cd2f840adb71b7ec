"""Snapshots: upsert, change classification, change manifest, versioned storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiere.functions import presets as P
from cantiere.functions.text import blank_to_null
from cantiere.operators.dedupe import first_per_key, top_per_key

STATE = ("is_active", "first_seen", "last_seen", "last_run_id")
CHANGES = ("change_status", "change_badges", "change_run")
BADGES = {"new": "Nuovo", "updated": "Aggiornato", "evidence_added": "Evidenza aggiunta"}


def record_key(external_id: Column, cup: Column, source: Column, title: Column) -> Column:
    """Snapshot key: external id, project code, else source and title."""
    return F.coalesce(blank_to_null(external_id), blank_to_null(cup), F.concat_ws(":", source, title))


def as_snapshot(batch: DataFrame, run_id: str, now: Column) -> DataFrame:
    """First snapshot: every record active and new."""
    return batch.withColumns({
        "is_active": F.lit(True), "first_seen": now, "last_seen": now, "last_run_id": F.lit(run_id),
    })


def upsert(snapshot: DataFrame, batch: DataFrame, source: str, run_id: str, now: Column,
           position: Sequence[Column], deactivate: bool = True) -> DataFrame:
    """New snapshot after loading a batch of one source.

    Batch records become active, keep their first sighting and take the run's time and id.
    With ``deactivate`` (complete batches) the source's other records become inactive.
    ``position`` orders the batch; the first row of a key in that order wins.
    """
    newest = top_per_key(batch, ["record_key"], position)
    fields = [c for c in snapshot.columns if c != "record_key" and c not in STATE]
    old = snapshot.select("record_key", F.struct(*fields, *STATE).alias("o"))
    new = newest.select("record_key", F.struct(*fields).alias("n"))
    j = old.join(new, "record_key", "full_outer")
    loaded = F.col("n").isNotNull()
    active = F.col("o.is_active")
    if deactivate:
        active = F.when(F.col("o.source") == source, F.lit(False)).otherwise(active)
    return j.select(
        "record_key",
        *[F.when(loaded, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields],
        F.when(loaded, F.lit(True)).otherwise(active).alias("is_active"),
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(loaded, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(loaded, F.lit(run_id)).otherwise(F.col("o.last_run_id")).alias("last_run_id"),
    )


def active_by_source(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("source").agg(F.count_if(F.col("is_active")).alias("active_records"))


# -- change classification ---------------------------------------------------


def signature(df: DataFrame, has_contractor: Column, fields: Sequence[str] = P.SIGNATURE_FIELDS,
              awards: str | None = "awards",
              award_fields: Sequence[str] = ("cig", "contractor_set", "contractors", "contractor_tax_codes", "award_date", "award_result", "award_amount_eur")) -> Column:
    """SHA-1 over the compared fields, the contractor flag and the awards in fixed order."""
    text = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    parts = [text(F.col(c)).alias(c) for c in fields if c in df.columns]
    parts.append(F.coalesce(has_contractor, F.lit(False)).alias("has_contractor"))
    if awards and awards in df.columns:
        inner = df.schema[awards].dataType.elementType.fieldNames()
        as_text = lambda a, f: text(a[f]) if not _is_array(df, awards, f) else F.to_json(a[f])
        compact = F.transform(awards, lambda a: F.struct(*[as_text(a, f).alias(f) for f in award_fields if f in inner]))
        parts.append(F.array_sort(compact).alias("awards"))
    return F.sha1(F.to_json(F.struct(*parts)))


def _is_array(df: DataFrame, awards: str, field: str) -> bool:
    return df.schema[awards].dataType.elementType[field].dataType.typeName() == "array"


def keyed_state(df: DataFrame, key: Column, has_contractor: Column, sig: Column, position: Sequence[Column]) -> DataFrame:
    """One comparable row per identity key: signature, contractor flag, branch."""
    rows = df.select(
        key.alias("identity_key"), sig.alias("signature"), F.coalesce(has_contractor, F.lit(False)).alias("has_contractor"),
        F.coalesce(blank_to_null(F.col("branch")), F.lit("Non assegnata")).alias("branch"),
        *[p.alias(f"_p{i}") for i, p in enumerate(position)],
    )
    first = first_per_key(rows, ["identity_key"], [F.asc(f"_p{i}") for i in range(len(position))])
    return first.select("identity_key", "signature", "has_contractor", "branch")


def delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Change status per identity key between two :func:`keyed_state` tables.

    A newly named contractor takes precedence over other changes.
    """
    p, c = previous.alias("p"), current.alias("c")
    j = p.join(c, "identity_key", "full_outer")
    status = (
        F.when(F.col("c.signature").isNull(), "removed")
        .when(F.col("p.signature").isNull(), "new")
        .when(F.col("c.has_contractor") & ~F.col("p.has_contractor"), "evidence_added")
        .when(F.col("c.signature") != F.col("p.signature"), "updated")
        .otherwise("unchanged")
    )
    return j.select("identity_key", status.alias("change_status"), F.coalesce("c.branch", "p.branch").alias("branch"))


def annotate(current: DataFrame, key: Column, changes: DataFrame, run: str) -> DataFrame:
    """Current records with change status, badge and run; stale change columns are replaced."""
    news = changes.filter(F.col("change_status").isin("new", "updated", "evidence_added"))
    news = news.select(F.col("identity_key").alias("_k"), "change_status")
    rows = current.drop(*CHANGES).withColumn("_key", key)
    badge = F.create_map(*[F.lit(x) for pair in BADGES.items() for x in pair])
    return rows.join(news, F.col("_key") == F.col("_k"), "left").drop("_k", "_key").withColumns({
        "change_badges": F.when(F.col("change_status").isNotNull(), F.array(F.try_element_at(badge, F.col("change_status")))),
        "change_run": F.when(F.col("change_status").isNotNull(), F.lit(run)),
    })


def manifest(changes: DataFrame, by: Sequence[str] = ("branch",)) -> DataFrame:
    """Change counts per branch (or overall with ``by=()``)."""
    n = lambda s: F.count_if(F.col("change_status") == s)
    return changes.groupBy(*by).agg(
        n("new").alias("new"), n("updated").alias("updated"), n("evidence_added").alias("evidence_added"),
        n("removed").alias("removed"),
        F.count_if(F.col("change_status") != "unchanged").alias("total_changes"),
    ).filter(F.col("total_changes") > 0)


def manifest_order() -> list[Column]:
    return [F.desc(F.col("new") + F.col("updated") + F.col("evidence_added")), F.desc("new"), F.desc("evidence_added"), F.asc("branch")]
