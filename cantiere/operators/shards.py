"""Branch shards with a size cap, and their index."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantiere.functions import presets as P
from cantiere.functions.text import slug
from cantiere.operators.report import size_status
from cantiere.session import scratch_dir

MEGABYTE = 1024 * 1024
#: Records of a branch whose pointers one group follows.
BLOCK_ROWS = 1 << 16


def with_row_bytes(df: DataFrame, columns: Sequence[str], money: Sequence[str] = ("value_eur",), name: str = "row_bytes") -> DataFrame:
    """Size of every record as compact JSON plus its separator; money counts with two decimals."""
    shown = [F.col(c).cast("decimal(18,2)").alias(c) if c in money else F.col(c) for c in columns]
    text = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    return df.withColumn(name, F.octet_length(text) + F.lit(2))


def pack_parts(df: DataFrame, order: Sequence[tuple[str, bool]], key: str, max_bytes: int,
               branch: str = "listed_branch", size: str = "row_bytes", block: int = BLOCK_ROWS) -> DataFrame:
    """Add the part number (long, from 1) of every record of a branch: next fit, in order.

    A part takes records as long as they fit into ``max_bytes``; the first one that does not starts the next part, and a record
    above the cap has a part of its own.  ``order`` lists (column, descending); ``key`` makes it total.

    The walk is not sequential.  Records are range-partitioned by branch and order; one row per branch and range gives the
    bytes and records ahead of it.  For every record, the start of the next part if a part began here comes from a merge of the
    record ends with the record starts plus the cap.  Blocks of ``block`` records follow these pointers inside,
    the chain over blocks is found by doubling jumps, and each block then numbers its records from the one start that enters it.
    """
    spark = df.sparkSession
    df = _landed(spark, df, "whole")  # read for the sample of the ranges, the ranges and the result
    records = _landed(spark, _positions(df, order, key, branch, size), "records")
    jumps = _landed(spark, _next_starts(records, max_bytes), "jumps")
    rows = jumps.withColumn("block", F.expr(f"idx DIV {block}"))

    schema = f"branch {dict(jumps.dtypes)['branch']}, block long, idx long, target long, hops long"
    exits = _landed(spark, rows.select("branch", "block", "idx", "next").groupBy("branch", "block").applyInPandas(_exits, schema), "exits")
    entries = _entries(spark, exits)
    known = exits.select(F.col("branch").alias("_b"), F.col("block").alias("_block"), F.col("idx").alias("entry"), F.col("hops").alias("_hops"))
    same = F.col("branch").eqNullSafe(F.col("_b"))
    started = entries.join(known, same & (F.col("idx") == F.col("entry"))).select("_b", "_block", "entry", "part", "_hops")
    blocks = exits.select("branch", "block").distinct().join(started, same & (F.col("block") == F.col("_block")), "left")
    ahead = Window.partitionBy("branch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.col("part") + F.col("_hops") - 1, ignorenulls=True).over(ahead)
    blocks = blocks.select(F.col("branch").alias("_b"), F.col("block").alias("_block"), F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce(last, F.lit(0)).alias("before"))
    marked = rows.join(blocks, same & (F.col("block") == F.col("_block"))).select("branch", "block", "record", "idx", "next", "entry", "before")
    kinds = dict(marked.dtypes)
    numbered = marked.groupBy("branch", "block").applyInPandas(_numbered, f"_branch {kinds['branch']}, _record {kinds['record']}, part long")
    return df.join(numbered, df[branch].eqNullSafe(F.col("_branch")) & (df[key] == F.col("_record"))).select(df["*"], "part")


def _landed(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Written once and read back: numbers of ranges must not change on a retry."""
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, keys: Sequence[Column], sort: Sequence[Column], purpose: str) -> DataFrame:
    """Rows in order over ranges: ``_seq`` rises with the order, ``_range`` is its upper part."""
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*sort).withColumn("_seq", F.monotonically_increasing_id())
    return _landed(df.sparkSession, rows, purpose).withColumn("_range", F.shiftright("_seq", 33))


def _stretches(ranged: DataFrame, *sums: str) -> DataFrame:
    """One row per branch and range: its first number, and what lies ahead of it in the branch."""
    totals = ranged.groupBy("branch", "_range").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in sums])
    ahead = Window.partitionBy("branch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("branch").alias("_b"), F.col("_range").alias("_r"), "_first", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_ahead{c}") for c in ("_rows", *sums)])


def _positions(df: DataFrame, order: Sequence[tuple[str, bool]], key: str, branch: str, size: str) -> DataFrame:
    """branch, record, idx (place in the branch, from 0), start, end: bytes of the branch before and with the record."""
    named = {f"_o{i}": (c, down) for i, (c, down) in enumerate(order) if c != key}
    slim = df.select(F.col(branch).alias("branch"), F.col(key).alias("record"), F.col(size).cast("long").alias("_size"), *[F.col(c).alias(n) for n, (c, _) in named.items()])
    sort = [F.asc("branch"), *[F.desc(n) if down else F.asc(n) for n, (_, down) in named.items()], F.asc("record")]
    ranged = _ranged(slim, sort, sort, "ranges").select("branch", "record", "_size", "_seq", "_range")
    inside = Window.partitionBy("branch", "_range").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.withColumn("_upto", F.sum("_size").over(inside))
    placed = within.join(_stretches(ranged, "_size"), F.col("branch").eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r")))
    end = F.col("_ahead_size") + F.col("_upto")
    return placed.select("branch", "record", (F.col("_ahead_rows") + F.col("_seq") - F.col("_first")).alias("idx"), (end - F.col("_size")).alias("start"), end.alias("end"))


def _next_starts(records: DataFrame, max_bytes: int) -> DataFrame:
    """branch, record, idx, next: the record that no longer fits into a part that starts with this one.

    Record ends and, as questions, starts plus the cap are sorted together.  Before the question of record i stand i
    other questions, so its place minus i is the number of records that end within the cap.
    """
    none = F.lit(None).cast(records.schema["record"].dataType)
    ends = records.select("branch", none.alias("record"), "idx", F.col("end").alias("pos"), F.lit(0).alias("kind"))
    asked = records.select("branch", "record", "idx", (F.col("start") + F.lit(max_bytes).cast("long")).alias("pos"), F.lit(1).alias("kind"))
    sort = [F.asc(c) for c in ("branch", "pos", "kind", "idx")]
    ranged = _ranged(ends.unionByName(asked), sort, sort, "merge")
    placed = ranged.filter("kind = 1").join(_stretches(ranged), F.col("branch").eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r")))
    fitting = F.col("_ahead_rows") + F.col("_seq") - F.col("_first") - F.col("idx")
    return placed.select("branch", "record", "idx", F.greatest(fitting, F.col("idx") + 1).alias("next"))


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where a part that starts at each record of a block leads out of the block, and over how many starts."""
    pdf = pdf.sort_values("idx")
    first, end = int(pdf["idx"].iloc[0]), int(pdf["idx"].iloc[-1]) + 1
    target, hops = pdf["next"].to_numpy(np.int64, copy=True), np.ones(len(pdf), np.int64)
    while (inside := target < end).any():
        via = target[inside] - first
        hops[inside], target[inside] = hops[inside] + hops[via], target[via]
    return pdf[["branch", "block", "idx"]].assign(target=target, hops=hops)


def _entries(spark: SparkSession, exits: DataFrame) -> DataFrame:
    """branch, idx, part of the part starts by which the chain enters its blocks, by doubling jumps between blocks."""
    entries = exits.filter("idx = 0").select("branch", "idx", F.lit(1).cast("long").alias("part"))
    named = exits.select(F.col("branch").alias("_b"), F.col("idx").alias("_i"), F.col("target").alias("_target"), F.col("hops").alias("_hops"))
    same = F.col("branch").eqNullSafe(F.col("_b"))
    wanted = exits.select("branch", F.col("target").alias("idx")).union(entries.select("branch", "idx")).distinct()
    jumps = _landed(spark, wanted.join(named, same & (F.col("idx") == F.col("_i"))).select("branch", "idx", F.col("_target").alias("target"), F.col("_hops").alias("hops")), "jumps")
    longest = exits.groupBy("branch").agg(F.max("block").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        ahead = jumps.select(F.col("branch").alias("_b"), F.col("idx").alias("_i"), F.col("target").alias("_target"), F.col("hops").alias("_hops"))
        reached = entries.join(ahead, same & (F.col("idx") == F.col("_i"))).select("branch", F.col("_target").alias("idx"), (F.col("part") + F.col("_hops")).alias("part"))
        entries = _landed(spark, entries.union(reached), "entries")
        jumps = _landed(spark, jumps.join(ahead, same & (F.col("target") == F.col("_i"))).select("branch", "idx", F.col("_target").alias("target"), (F.col("hops") + F.col("_hops")).alias("hops")), "jumps")
    return entries


def _numbered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Part of each record of a block: ``before`` up to the entry, one more at every start."""
    pdf = pdf.sort_values("idx")
    first, follow, at = int(pdf["idx"].iloc[0]), pdf["next"].tolist(), int(pdf["entry"].iloc[0])
    starts = np.zeros(len(pdf), np.int64)
    while 0 <= at - first < len(follow):
        starts[at - first] = 1
        at = follow[at - first]
    return pd.DataFrame({"_branch": pdf["branch"], "_record": pdf["record"], "part": pdf["before"] + np.cumsum(starts)})


def shard_index(packed: DataFrame, branch: str = "listed_branch", size: str = "row_bytes",
                warn_mb: float = P.SHARD_GLOBAL_WARN_MB) -> DataFrame:
    """Count, bytes, size warning and size status per branch and part."""
    per_part = packed.groupBy(branch, "part").agg(F.count(F.lit(1)).alias("count"), F.sum(size).alias("size_bytes"))
    mb = F.col("size_bytes") / MEGABYTE
    return per_part.select(branch, slug(F.col(branch)).alias("slug"), "part", "count", "size_bytes",
                           (mb > warn_mb).alias("over_limit"), size_status(mb).alias("size_status"))


def branch_index(index: DataFrame, branch: str = "listed_branch") -> DataFrame:
    """Per branch: records, parts, bytes; largest first."""
    return index.groupBy(branch, "slug").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("parts"), F.sum("size_bytes").alias("total_size_bytes")
    ).orderBy(F.desc("count"), branch)


def write_shards(packed: DataFrame, path: str, branch: str = "listed_branch", fmt: str = "json") -> None:
    """One folder per branch and part; rows of one part are written by one task."""
    out = packed.withColumn("branch_slug", slug(F.col(branch)))
    out.repartition("branch_slug", "part").write.mode("overwrite").partitionBy("branch_slug", "part").format(fmt).save(path)
