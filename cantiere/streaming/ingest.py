"""Incremental snapshot ingest: new files only, deduplicated, merged into the snapshot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cantiere.operators.dedupe import first_per_key
from cantiere.operators.store import BUCKET_ROWS, SnapshotTable


def ingest_available(spark: SparkSession, folder: str, schema: StructType, table_path: str, checkpoint: str, source: str,
                     prepare: Callable[[DataFrame], DataFrame], order: Sequence[Column], fmt: str = "parquet", bucket_rows: int = BUCKET_ROWS) -> SnapshotTable:
    """Process the files that arrived since the last call, then stop.

    The stream checkpoint remembers the files, so a second call without new files changes nothing.
    ``prepare`` maps raw rows to snapshot rows with a ``record_key``.  A batch is only a part of
    the source, so records that are missing from it stay active; only the buckets of its keys are rewritten.  A batch that is run again after
    a failure is merged again with the same result.
    """
    table = SnapshotTable(spark, table_path, bucket_rows)

    def merge(batch: DataFrame, batch_id: int) -> None:
        run_id = f"batch-{batch_id}"
        rows = first_per_key(prepare(batch), ["record_key"], list(order))
        table.merge(rows, run_id, F.current_timestamp(), source, list(order))

    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table
