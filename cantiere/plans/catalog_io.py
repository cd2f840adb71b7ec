"""Catalogue: sources, sinks, shards, incremental ingest and register parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantiere.functions import values as V
from cantiere.operators import geo, shards
from cantiere.operators.store import SnapshotTable
from cantiere.plans import bindings as B
from cantiere.plans import fixtures, national
from cantiere.plans import sqltext as S
from cantiere.plans.catalog_score import SHORT, operational_shortlist
from cantiere.session import scratch_dir
from cantiere.sources import files
from cantiere.streaming.ingest import ingest_available

# -- files -------------------------------------------------------------------


def zip_csv_scan(spark, sf) -> DataFrame:
    """All links written as zipped csv by the executors, then scanned with delimiter detection."""
    folder = scratch_dir(spark, "zip")
    fixtures.write_zip_csv(B.links(spark, sf).toDF("CUP", "CIG"), folder, delimiter="|")
    rows = files.read_zip(spark, folder)
    return rows.groupBy(F.col("CUP").alias("cup"), F.col("CIG").alias("cig")).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.min("_row") >= 1).alias("positioned"))


def zip_largest_member(spark, sf) -> DataFrame:
    """Links in archives that also hold a small member, of which only the largest member is read."""
    folder = scratch_dir(spark, "zip")
    fixtures.write_zip_csv(B.links(spark, sf).toDF("CUP", "CIG"), folder, members=1, note="CUP;CIG\nnone;none\n")
    rows = files.read_zip(spark, folder, members="largest", candidates=";,")
    return rows.groupBy(F.col("CUP").alias("cup"), F.col("CIG").alias("cig")).agg(F.count(F.lit(1)).alias("n_rows"))


def json_rooted(spark, sf) -> DataFrame:
    """Customers as JSON documents of up to 1000 records under a root key, read back as rows."""
    folder = scratch_dir(spark, "rooted")
    c = B.table(spark, sf, "customer").withColumn("chunk", F.floor(F.col("c_custkey") / 1000))
    record = F.struct("c_custkey", "c_name", F.struct(F.col("c_mktsegment").alias("segment")).alias("about"))
    docs = c.groupBy("chunk").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(record).alias("records"))).alias("value"))
    docs.repartition("chunk").write.partitionBy("chunk").text(folder)
    rows = files.read_json_rows(spark, folder)
    return rows.select("c_custkey", "c_name", F.col("about.segment").alias("segment"))


def sink_round_trip(spark, sf) -> DataFrame:
    """Shortlist to a ``;`` file with byte-order mark and to nested JSON, both read back and joined."""
    folder = scratch_dir(spark, "sink")
    rows = operational_shortlist(spark, sf)
    files.write_delimited(rows, f"{folder}/csv", ["cup", "title", "value_eur", "client", "absent"], bom=True)
    nested = rows.select("cup", F.split("segment_tags", r" \| ").alias("tags"), F.struct("region", "province").alias("place"))
    files.write_json(nested, f"{folder}/json")
    flat = files.read_delimited(spark, f"{folder}/csv")
    doc = spark.read.json(f"{folder}/json")
    flat = flat.select("cup", "title", V.money(F.col("value_eur")).alias("value_eur"), "client", "absent")
    return flat.join(doc, "cup").select("cup", "title", "value_eur", "client", "absent", V.pipe_text(F.col("tags")).alias("tags"), "place.region")


def source_fallback(spark, sf) -> DataFrame:
    """First source that exists, then a roll-up of it."""
    rows = files.first_source(spark, [("json", f"{sf}/orders.json"), ("delimited", f"{sf}/orders.csv"), ("parquet", f"{sf}/orders.parquet")])
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


def run_log(spark, sf) -> DataFrame:
    """Run row opened and closed around a load of the orders."""
    log = files.RunLog(spark, scratch_dir(spark, "runs"))
    log.start("run-1", "orders", "full load")
    log.finish("run-1", "orders", B.table(spark, sf, "orders"))
    return log.runs().select("run_id", "source", "total_records", "note", (F.col("completed_at") >= F.col("started_at")).alias("closed"))


def incremental_ingest(spark, sf) -> DataFrame:
    """Events arriving in two waves of day files, merged into a per-user snapshot by a stream."""
    folder = scratch_dir(spark, "ingest")
    events = B.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    late = F.col("day") >= F.lit("2024-01-16").cast("date")
    schema = events.drop("day").schema

    def prepare(df: DataFrame) -> DataFrame:
        return df.select(F.col("user_id").cast("string").alias("record_key"), F.col("event_type").alias("source"), "event_id", "ts", "value")

    def load() -> None:
        ingest_available(spark, f"{folder}/in/*", schema, f"{folder}/table", f"{folder}/checkpoint", "events", prepare, [F.asc("ts"), F.asc("event_id")], bucket_rows=200)

    events.filter(~late).write.partitionBy("day").parquet(f"{folder}/in")
    load()
    events.filter(late).write.mode("append").partitionBy("day").parquet(f"{folder}/in")
    load()
    load()  # nothing new: no batch
    return SnapshotTable(spark, f"{folder}/table").read().select("record_key", "source", "event_id", "value", "is_active", "last_run_id")


INGEST_SQL = """WITH e AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS wave FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, wave ORDER BY ts, event_id) = 1)
SELECT CAST(user_id AS VARCHAR) AS record_key, event_type AS source, event_id, value, true AS is_active, 'batch-' || wave AS last_run_id
FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY wave DESC) = 1"""

# -- shards ------------------------------------------------------------------


def _packed(spark, sf) -> DataFrame:
    rows = geo.fan_out(B.with_commercial_score(B.assigned(spark, sf)))
    sized = shards.with_row_bytes(rows, [c for c in rows.columns if c != "listed_branch"])
    sized = sized.select("listed_branch", "cup", "row_bytes", "commercial_score", "value_eur")
    return shards.pack_parts(sized, [("commercial_score", True), ("value_eur", True)], "cup", 200_000)


def sharded_parts(spark, sf) -> DataFrame:
    return _packed(spark, sf).select("listed_branch", "cup", "row_bytes", "part")


def shard_index(spark, sf) -> DataFrame:
    return shards.branch_index(shards.shard_index(_packed(spark, sf)))


def shard_sizes(spark, sf) -> DataFrame:
    return shards.shard_index(_packed(spark, sf)).orderBy("listed_branch", "part")


_JSON_TEXT = ["cup", "title", "category", "region", "province", "municipality", "client", "status", "source_url", "phase", "value_band",
              "branch", "branch_candidates", "branch_confidence", "branch_assignment_method", "CAST(decided_on AS VARCHAR) AS decided_on"]
_JSON_OTHER = ["CAST(value_eur AS DECIMAL(18,2)) AS value_eur", "year", "band_order", "commercial_score"]


def _json_bytes() -> str:
    """Length of the compact JSON of a record with its separator, without relying on a JSON function."""
    out = []
    for column in _JSON_TEXT + _JSON_OTHER:
        value, _, name = column.partition(" AS ") if " AS " in column and not column.startswith("CAST") else (column, "", column)
        if column.startswith("CAST"):
            value, name = column.rsplit(" AS ", 1)
        size = f"strlen(CAST({value} AS VARCHAR))" + (" + 2" if column in _JSON_TEXT else "")
        out.append(f"{len(name) + 4} + coalesce({size}, 4)")
    return " + ".join(out) + " + 1 + 2"


_PARTS = f"""RECURSIVE {S.PROJECTS},\n{S.BRANCH_MAP},\n{S.ASSIGNED},\n{S.COMMERCIAL},
whole AS (SELECT a.*, c.phase, c.value_band, c.commercial_score, 1 AS band_order FROM assigned a JOIN commercial c USING (cup)),
listed AS (SELECT w.*, unnest(CASE WHEN branch = 'AMBIGUA' THEN list_concat(['AMBIGUA'], string_split(branch_candidates, ' | ')) ELSE [branch] END) AS listed_branch FROM whole w),
sized AS (SELECT listed_branch, cup, commercial_score, value_eur, {_json_bytes()} AS row_bytes FROM listed),
placed AS (SELECT *, CAST(sum(row_bytes) OVER (PARTITION BY listed_branch ORDER BY commercial_score DESC, value_eur DESC, cup) AS BIGINT) - row_bytes AS start FROM sized),
walk AS (SELECT listed_branch, CAST(0 AS BIGINT) AS start FROM placed GROUP BY listed_branch
  UNION ALL SELECT w.listed_branch, min(p.start) FROM walk w JOIN placed p ON p.listed_branch = w.listed_branch AND p.start > w.start
    AND p.start + p.row_bytes - w.start > 200000 GROUP BY w.listed_branch, w.start),
parts AS (SELECT p.listed_branch, p.cup, p.row_bytes, count(*) AS part FROM placed p JOIN walk w ON w.listed_branch = p.listed_branch AND w.start <= p.start
    GROUP BY p.listed_branch, p.cup, p.row_bytes),
sizes AS (SELECT listed_branch, replace(listed_branch, ' ', '_') AS slug, part, count(*) AS count, CAST(sum(row_bytes) AS BIGINT) AS size_bytes FROM parts GROUP BY ALL)"""

# -- register ----------------------------------------------------------------

_REGISTER = ["cup", "title", "description", "region", "province", "municipality", "address", "category", "intervention_type", "phase",
             "status", "client", "value_eur", "funding", "year", "commercial_score", "notes"]


def register_positional(spark, sf) -> DataFrame:
    """Positional register rows to filtered, classified and scored projects."""
    return national.parse_positional(fixtures.positional_register(spark, sf)).select(*_REGISTER)


_CODE = ("'C' || lpad(substring(province, 8, 2), 2, '0') || 'E' || substring(CAST(year AS VARCHAR), 3, 2) || "
         "lpad(CAST(CAST(substring(cup, 2) AS BIGINT) AS VARCHAR), 9, '0')")
_TEXT = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixtures.DESCRIPTIONS.items()) + " END"
POSITIONAL_SQL = f"""WITH {S.PROJECTS},
k AS (SELECT *, {_TEXT} AS txt FROM projects WHERE value_eur >= 200000 AND category <> 'FURNITURE'
        AND (category <> 'HOUSEHOLD' OR region = 'EUROPE')),
c AS (SELECT {_CODE} AS cup, title,
    CASE category WHEN 'BUILDING' THEN 'Scuole / formazione' WHEN 'MACHINERY' THEN 'Industriale / logistica'
         WHEN 'AUTOMOBILE' THEN 'Infrastrutture / parcheggi' ELSE 'Altro' END AS category,
    txt AS description, CASE WHEN region <> 'ASIA' THEN region END AS region,
    CASE WHEN region = 'AFRICA' THEN 'XX' ELSE province END AS province, municipality,
    CASE WHEN year > 1998 THEN 'Via Roma' ELSE municipality END AS address,
    CASE category WHEN 'BUILDING' THEN 'ristrutturazione' WHEN 'MACHINERY' THEN 'nuova costruzione' WHEN 'AUTOMOBILE' THEN 'messa in sicurezza' END AS intervention_type,
    {S.PHASE} AS phase, 'PROGETTO ' || status AS status, client, value_eur,
    CASE WHEN region = 'EUROPE' THEN 'PRIVATA' ELSE 'Statale' END AS funding, year,
    'Classificazione: ' || CASE WHEN category = 'HOUSEHOLD' THEN 'LAVORI PUBBLICI' ELSE 'OPERE' END
      || ' | Natura:  | Tipologia:  | Area:  | Settore: ' || title || ' | Sottosettore:  | Anno decisione: ' || year AS notes FROM k)
SELECT *, greatest(0, least(100, CASE WHEN category <> 'Altro' THEN 25 ELSE 0 END + CASE WHEN value_eur >= 300000 THEN 12 ELSE 6 END + 15
   + CASE WHEN intervention_type IS NOT NULL THEN 10 ELSE 0 END + 8 + CASE WHEN region IS NOT NULL THEN 3 ELSE 0 END + 3 + 4)) AS commercial_score FROM c"""

_NAMED = ["cup", "title", "region", "province", "municipality", "client", "category", "intervention_type", "phase", "status", "value_eur",
          "year", "cig", "contractor_name", "contractor_vat", "rup", "contact_name", "contact_role", "contact_email", "enrichment_status", "commercial_score"]


def register_named(spark, sf) -> DataFrame:
    """Register rows with named columns: loose headers, evidence gates, regional rules."""
    return national.parse_named(fixtures.named_register(spark, sf)).select(*_NAMED)


NAMED_SQL = f"""WITH {S.PROJECTS},
c AS (SELECT cup, {_TEXT} || ' e lavori' AS title, region, province, municipality, client,
    CASE category WHEN 'BUILDING' THEN 'Scuole / formazione' WHEN 'MACHINERY' THEN 'Industriale / logistica'
         WHEN 'AUTOMOBILE' THEN 'Infrastrutture / parcheggi' ELSE 'Altro' END AS category,
    CASE category WHEN 'BUILDING' THEN 'ristrutturazione' WHEN 'MACHINERY' THEN 'nuova costruzione' WHEN 'AUTOMOBILE' THEN 'messa in sicurezza' END AS intervention_type,
    {S.PHASE} AS phase, 'STATO ' || status AS status, value_eur, year,
    CASE WHEN status = 'CHIUSO' THEN 'Z' || substring(cup, 2) END AS cig,
    CASE WHEN status = 'CHIUSO' THEN 'Impresa ' || client END AS contractor_name, CASE WHEN status = 'CHIUSO' THEN '01234' END AS contractor_vat,
    CASE WHEN year > 1998 THEN 'Mario Rossi' END AS rup, CASE WHEN year > 1998 THEN 'Mario Rossi' END AS contact_name,
    CASE WHEN year > 1998 THEN 'RUP / responsabile procedimento' END AS contact_role,
    CASE WHEN year > 1998 THEN 'rup@example.org' END AS contact_email,
    CASE WHEN status = 'CHIUSO' THEN 'parzialmente arricchito' ELSE 'da arricchire' END AS enrichment_status
  FROM projects WHERE value_eur >= 200000 AND category <> 'FURNITURE')
SELECT *, greatest(0, least(100, CASE WHEN category <> 'Altro' THEN 25 ELSE 0 END + CASE WHEN value_eur >= 300000 THEN 12 ELSE 6 END
   + CASE WHEN phase = 'chiuso' THEN 0 ELSE 20 END + CASE WHEN intervention_type IS NOT NULL THEN 10 ELSE 0 END + 8
   + CASE WHEN contractor_name IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN rup IS NOT NULL THEN 8 ELSE 0 END + 5 + 3 + 3 + 4)) AS commercial_score FROM c"""

ENTRIES = {
    "zip_csv_scan": (zip_csv_scan, f"WITH {S.LINKS} SELECT cup, cig, count(*) AS n_rows, true AS positioned FROM links GROUP BY cup, cig"),
    "zip_largest_member": (zip_largest_member, f"WITH {S.LINKS} SELECT cup, cig, count(*) AS n_rows FROM links GROUP BY cup, cig"),
    "json_rooted": (json_rooted, "SELECT c_custkey, c_name, c_mktsegment AS segment FROM customer"),
    "sink_round_trip": (sink_round_trip, f"""WITH {S.SHORTLISTED}
SELECT cup, title, value_eur, client, CAST(NULL AS VARCHAR) AS absent, segment_tags AS tags, region FROM shortlist"""),
    "source_fallback": (source_fallback, "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY 1"),
    "run_log": (run_log, "SELECT 'run-1' AS run_id, 'orders' AS source, count(*) AS total_records, 'full load' AS note, true AS closed FROM orders"),
    "incremental_ingest": (incremental_ingest, INGEST_SQL),
    "sharded_parts": (sharded_parts, f"WITH {_PARTS} SELECT * FROM parts"),
    "shard_index": (shard_index, f"""WITH {_PARTS} SELECT listed_branch, slug, CAST(sum(count) AS BIGINT) AS count, count(*) AS parts,
  CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM sizes GROUP BY listed_branch, slug"""),
    "shard_sizes": (shard_sizes, f"WITH {_PARTS} SELECT *, false AS over_limit, 'ok' AS size_status FROM sizes"),
    "register_positional": (register_positional, POSITIONAL_SQL),
    "register_named": (register_named, NAMED_SQL),
}
