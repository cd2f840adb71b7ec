"""Guards that keep plans sound and cheap at scale: broadcasts, hot keys, repeated evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
LIST_LIMIT = 100_000
#: Bytes that one task reads at most, of files (a row group is never divided) or of a shuffle (a partition is never divided).
TASK_BYTES = 16 << 20


def bounded_tasks(spark: SparkSession, limit: int = TASK_BYTES) -> None:
    """Let a task read at most ``limit`` bytes; smaller settings stay.

    Joins and distinct rows keep what a task reads in memory, many times the size of the compressed shuffle. Spark sizes tasks by the
    number of cores, up to 128 MB of files and 64 MB of a shuffle, so tasks grew with the tables up to there. Now
    larger tables give more tasks, not larger ones.
    """
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if size(spark.conf.get(name)) > limit:
            spark.conf.set(name, str(limit))


def broadcast_if_small(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; larger tables keep Spark's own choice.

    The count stops after ``max_rows + 1`` rows.
    """
    rows = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if rows <= max_rows else dim


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that later filters on them do not evaluate them again.

    The optimizer moves a filter below a projection by inlining the projected expression, staged
    helper columns included.  It does not do that for a generator, here one that
    emits exactly one row.
    """
    extra = F.struct(*[c.alias(name) for name, c in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(extra)))


def lists_per_key(df: DataFrame, keys: Sequence[str], item: Column, items: str = "items",
                  limit: int = LIST_LIMIT) -> DataFrame:
    """Sorted distinct items per key, in rows of bounded size: ``keys, part, <items>, n_items``.

    Every key is spread over ``ceil(distinct items / limit)`` parts by item hash, one part up to
    ``limit``; ``n_items`` is the key's total and stands in every part.  Repeated rows are
    combined before anything meets, nothing is dropped and no job runs while the plan is built.

    Items of a key of one part are gathered where the join with the totals has brought them; only those of larger
    keys are sent on by part.
    """
    # the keys as one value that is never NULL: the join finds NULL keys, and its partitions serve the lists
    once = df.select(F.struct(*keys).alias("_key"), item.alias("_item")).filter(F.col("_item").isNotNull()).distinct()
    totals = once.groupBy("_key").agg(F.count(F.lit(1)).alias("n_items"))
    listed = [F.array_sort(F.collect_list("_item")).alias(items), F.first("n_items").alias("n_items")]
    whole = once.join(totals.filter(F.col("n_items") <= limit), "_key").groupBy("_key").agg(*listed)
    part = F.pmod(F.xxhash64("_item"), F.ceil(F.col("n_items") / F.lit(limit))).cast("int")
    divided = once.join(totals.filter(F.col("n_items") > limit), "_key").groupBy("_key", part.alias("part")).agg(*listed)
    out = ["_key.*", "part", items, "n_items"]
    return whole.withColumn("part", F.lit(0)).select(*out).unionByName(divided.select(*out))
