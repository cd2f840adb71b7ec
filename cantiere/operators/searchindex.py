"""Search index: bitmaps of blocks per facet value and trigram, and value ranges per block.

Rows are stored in numbered blocks of neighbours.  For each facet value, and each three letters of the searched text, a
bitmap tells the blocks that hold it; each block has the range of its values and dates.  A request is answered from the blocks
that satisfy all its conditions, by the filters of the plain search, so results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantiere.operators.geo import branch_list
from cantiere.operators.search import TEXT_COLUMNS, SearchRequest, matches

#: Rows of a block: the unit that a request reads.
BLOCK_ROWS = 100_000
#: Rows of a folder, which holds neighbouring blocks (one, if blocks are as large): a folder a block would be very many small files.
FOLDER_ROWS = 100_000
#: Bytes of text whose trigrams are found at once.
TEXT_BYTES = 1 << 20
FACETS = ("region", "province", "municipality", "segment", "change_status")
GRAM, TEXT, FOLDER = 3, "text", "blocks"


def searched_text(columns: Sequence[str]) -> Column:
    """The text that a request's words are looked up in."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def _block_grams(blocks: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct trigrams of each block's texts, and their blocks; a shorter text counts as a whole."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    short = {(int(b), t) for b, t, n in zip(blocks, texts, lengths) if n < GRAM}
    values, where = [t for _, t in short], np.array([b for b, _ in short], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    if len(points) < GRAM:
        return values, where
    # code points numbered densely: a trigram is one number, of a block's only the distinct ones stay
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int32)
    number[letters] = np.arange(len(letters))
    n, dense, owner = len(letters), number[points].astype(np.int64), np.repeat(np.arange(len(texts)), lengths)
    whole = owner[:-2] == owner[2:]
    codes, of = ((dense[:-2] * n + dense[1:-1]) * n + dense[2:])[whole], blocks[owner[:-2][whole]]
    if len(of) and (np.diff(of) < 0).any():
        order = np.argsort(of, kind="stable")
        codes, of = codes[order], of[order]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    found = [np.unique(part) for part in np.split(codes, starts[1:])] if len(of) else []
    if not found:
        return values, where
    distinct, at = np.unique(np.concatenate(found), return_inverse=True)
    spelled = letters[np.stack([distinct // n // n, distinct // n % n, distinct % n], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    grams = np.array([spelled[i:i + GRAM] for i in range(0, len(spelled), GRAM)], object)
    return values + grams[at].tolist(), np.concatenate([where, np.repeat(of[starts], [len(f) for f in found])])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """value, block of ``block, text`` (UTF-8 bytes)."""
    for batch in batches:
        blocks, texts = batch.column(0).to_numpy(), batch.column(1)
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // TEXT_BYTES)) + 1):
            if len(rows):
                part = texts.slice(rows[0], len(rows)).to_pylist()
                values, where = _block_grams(blocks[rows], [t.decode("utf-8", "replace") for t in part])
                yield pa.record_batch([pa.array(values, pa.string()), pa.array(where, pa.int64())], ["value", "block"])


class SearchIndex:
    """Blocks, bitmaps and block ranges below one folder."""

    def __init__(self, spark: SparkSession, path: str, text_columns: Sequence[str] = TEXT_COLUMNS, value: str = "value_eur", date: str | None = "award_date"):
        self.spark, self.path, self.text_columns, self.value, self.date = spark, path.rstrip("/"), list(text_columns), value, date

    def build(self, df: DataFrame, cluster: Sequence[str], block_rows: int = BLOCK_ROWS) -> None:
        """Store the rows by neighbourhood (``cluster``) and index them; no group holds more than a block's rows."""
        ranged = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster).withColumn("_seq", F.monotonically_increasing_id())
        ranged.write.parquet(f"{self.path}/ranges")  # a number must not change on a retry
        ranged = self.spark.read.schema(ranged.schema).parquet(f"{self.path}/ranges").withColumn("_range", F.shiftright("_seq", 33))
        totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
        ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        # one row per range
        starts = F.broadcast(totals.select("_range", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")))
        row = F.col("_ahead") + F.col("_seq") - F.col("_first")
        rows = ranged.join(starts, "_range").withColumn("block", F.floor(row / block_rows).cast("long")).select(*df.columns, "block")
        # rows of a block lie together already; a page is a block, so that a reader of a few blocks skips the others of their folder
        folders = rows.withColumn(FOLDER, F.floor(F.col("block") / max(1, FOLDER_ROWS // block_rows)).cast("long"))
        folders.sortWithinPartitions(FOLDER, "block").write.partitionBy(FOLDER).option("parquet.page.row.count.limit", block_rows).parquet(f"{self.path}/rows")
        stored = self._stored()
        stats = [F.min(FOLDER).alias(FOLDER), F.min(F.coalesce(F.col(self.value), F.lit(0.0))).alias("low"), F.max(F.coalesce(F.col(self.value), F.lit(0.0))).alias("high")]
        if self.date:
            stats += [F.min(self.date).alias("first"), F.max(self.date).alias("last")]
        stored.groupBy("block").agg(*stats).write.parquet(f"{self.path}/blocks")
        # sent as block numbers: bitmaps combined before the exchange would be one of each term and task. Repeats set the same bit
        self._terms(stored.drop(FOLDER)).repartition("facet", "value").groupBy("facet", "value", F.bitmap_bucket_number(F.col("block") + 1).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(F.col("block") + 1)).alias("bits")).repartitionByRange("facet", "value").sortWithinPartitions(
            "facet", "value").write.parquet(f"{self.path}/terms")

    def _terms(self, rows: DataFrame) -> DataFrame:
        """facet, value, block: every facet value and every trigram of the searched text; a few more than once."""
        texts = rows.select("block", searched_text(self.text_columns).cast("binary").alias(TEXT))
        grams = texts.mapInArrow(_grams, "value string, block long").select(F.lit(TEXT).alias("facet"), "value", "block")
        # each facet by itself: few values a block, found before anything is built from them
        found = [grams]
        found += [rows.select(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), "block").distinct() for c in FACETS if c in rows.columns]
        if "branch" in rows.columns and "branch_candidates" in rows.columns:
            listed = F.explode(branch_list(F.col("branch"), F.col("branch_candidates"), False))
            found.append(rows.select("branch", "branch_candidates", "block").distinct().select(F.lit("branch").alias("facet"), listed.alias("value"), "block"))
        return reduce(DataFrame.unionByName, found).filter("value IS NOT NULL")

    def read(self) -> DataFrame:
        return self._stored().drop(FOLDER)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def wanted(self, request: SearchRequest) -> list[tuple[str, str]]:
        """The terms a block must have for a request."""
        out = [(c, getattr(request, c)) for c in ("branch", *FACETS) if getattr(request, c)]
        words = request.text.strip().lower()
        return out + sorted({(TEXT, words[i:i + GRAM]) for i in range(len(words) - GRAM + 1)})

    def candidates(self, request: SearchRequest) -> DataFrame:
        """block, blocks: those that may hold matches, and their folders."""
        blocks = self.spark.read.parquet(f"{self.path}/blocks")
        if request.value_min:
            blocks = blocks.filter(F.col("high") >= request.value_min)
        if request.value_max:
            blocks = blocks.filter(F.col("low") <= request.value_max)
        if self.date and request.date_from:
            blocks = blocks.filter(F.col("last") >= F.lit(request.date_from).cast("date"))
        if self.date and request.date_to:
            blocks = blocks.filter(F.col("first") <= F.lit(request.date_to).cast("date"))
        terms = self.wanted(request)
        if not terms:
            return blocks.select("block", FOLDER)
        one = F.lit(False)
        for facet, value in terms:
            one = one | ((F.col("facet") == facet) & (F.col("value") == value))
        found = self.spark.read.parquet(f"{self.path}/terms").filter(one)
        # a bitmap has 32,768 places; buckets and numbers count from 1
        bit = F.expr("shiftright(CAST(conv(hex(substring(bits, i DIV 8 + 1, 1)), 16, 10) AS INT), i % 8) & 1")
        places = found.select("facet", "value", "bucket", "bits", F.explode(F.sequence(F.lit(0), F.length("bits") * 8 - 1)).alias("i")).filter(bit == 1)
        held = places.select(((F.col("bucket") - 1) * 32_768 + F.col("i")).alias("block")).groupBy("block").count().filter(F.col("count") == len(terms))
        return blocks.join(held, "block", "left_semi").select("block", FOLDER)

    def search(self, request: SearchRequest, order: Sequence[Column], limit: int = 300) -> DataFrame:
        """First ``limit`` matches in the given order; only candidate blocks are read."""
        # at most one number per block
        found = self.candidates(request).collect()
        chosen, folders = [r["block"] for r in found], sorted({r[FOLDER] for r in found})
        here = F.col(FOLDER).isin(folders) & F.col("block").isin(chosen) if chosen else F.lit(False)
        rows = self._stored().filter(here).drop("block", FOLDER)
        options = {"text_columns": self.text_columns, "value": self.value} | ({"date": self.date} if self.date else {})
        return matches(rows, request, **options).orderBy(*order).limit(limit)
