"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cantiere.session import scratch_dir

#: Code points handled at once inside a task; a longer text forms a block of its own.
BLOCK_CHARS = 500_000
#: Bounds of one Arrow batch, so that batches of long texts stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def landed(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: lost executors cost no recomputation."""
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id written as text, modulo buckets; NULL ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def release_memory() -> None:
    """Give freed memory back: a worker lives on after its task, beside the next one of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pd.DataFrame], text: str, limit: int = BLOCK_CHARS) -> Iterator[pd.DataFrame]:
    """Cut batches into runs of rows with at most ``limit`` code points of text (one row at least); NULL becomes ''.

    Memory is released behind the last one.
    """
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True)
        pdf[text] = pdf[text].astype(object).where(pdf[text].notna(), "")
        run = pdf[text].str.len().to_numpy(np.int64).cumsum() // limit
        for _, part in pdf.groupby(run, sort=True):
            yield part.reset_index(drop=True)
        del pdf
    release_memory()


def arrow_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def split_sizes(lists: list[list]) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each consecutive segment; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "iub" else np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
