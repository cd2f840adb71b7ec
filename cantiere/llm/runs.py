"""Periodic runs of words: stretches that repeat with a smallest period, at least four times over.

A run of period q holds 3q consecutive places whose word returns q places later, so among the places 0, 3q,
6q, ... of every text one lies inside it: a harmonic grid of n/3 * ln n pairs for all periods. Each pair whose words agree
is extended to both sides by longest common extensions (``lce``), over many texts at once, and what is long
enough is a run; of equal stretches the smallest period counts.

A text is taken whole, whatever its length, and is a block of its own beyond BLOCK_BYTES; memory is linear in a block (times a
logarithm). NULL and blank texts have no words and no runs; repeated rows and equal or NULL ids are rows
of their own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cantiere.llm.common import arrow_blocks, release_memory, split_sizes
from cantiere.llm.lce import Extensions

#: A run is at least so long, and at least so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 400_000
#: Grid pairs held at once.
PAIRS = 500_000
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of many texts: text, start (in its text), length, period; by text, start and period.

    ``codes``: the words of all texts as numbers from 0, one text behind the other; ``sizes``: words of each.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    # one separator behind each text, each a number of its own
    spread = np.empty(len(codes) + len(sizes), np.int64)
    spread[np.arange(len(codes)) + owner] = codes
    spread[np.cumsum(sizes + 1) - 1] = int(codes.max(initial=-1)) + 1 + np.arange(len(sizes))
    begin, n = first + np.arange(len(sizes)), len(spread)
    periods = sizes // LEAST_TIMES
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    grid = LEAST_TIMES - 1
    points = -(-(sizes[text] - q) // (grid * q))
    ends = np.cumsum(points)
    found, later, earlier = [], None, None
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = np.repeat(np.arange(at, stop), points[at:stop])
        place = np.arange(len(some)) - (ends[some] - points[some] - (ends[at - 1] if at else 0))
        period = q[some]
        i = begin[text[some]] + place * grid * period
        agree = spread[i] == spread[i + period]
        i, period = i[agree], period[agree]
        if len(i):
            if later is None:
                later, earlier = Extensions(spread), Extensions(spread[::-1])
            ahead, back = later(i, i + period), earlier(n - i, n - i - period)
            length = ahead + back + period
            long = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
            found.append(np.stack([(i - back)[long], length[long], period[long]]))
        at = stop
    start, length, period = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    keep = np.ones(len(start), bool)  # the same stretch again: with a multiple of its period, or from another pair
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    text = np.searchsorted(begin, start, "right") - 1
    start = start - begin[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def altered(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) for one text in ten: its words from a on repeat the p words there. NULL ids are left alone."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def repetitions(docs: DataFrame, alter: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without the repeated words of its runs.

    ``alter(doc_id, n_words)`` may ask for a text to be made periodic before.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_blocks(batches, "text", BLOCK_BYTES):
            ids = block["doc_id"].to_pylist()
            words = [(t or "").encode("utf-8").split() for t in block["text"].to_pylist()]
            if alter:
                for k, (doc_id, one) in enumerate(zip(ids, words)):
                    if (change := alter(doc_id, len(one))) is not None:
                        a, p = change
                        words[k] = one[:a] + (one[a:a + p] * -(-(len(one) - a) // p))[:len(one) - a]
            sizes = split_sizes(words)
            flat = np.empty(int(sizes.sum()), object)
            flat[:] = [w for one in words for w in one]
            text, start, length, period = find_runs(pd.factorize(flat)[0], sizes)
            first = np.cumsum(sizes) - sizes
            edges = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edges, (first[text] + start + period), 1)
            np.add.at(edges, (first[text] + start + length), -1)
            kept = np.cumsum(edges)[:-1] == 0
            collapsed, with_runs = [b" ".join(one) for one in words], np.unique(text).tolist()
            for k in with_runs:
                span = slice(int(first[k]), int(first[k] + sizes[k]))
                collapsed[k] = b" ".join(flat[span][kept[span]].tolist())
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(RUN))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block["doc_id"], pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first by start and period of equals."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, x: F.when(better(best, x), x).otherwise(best))


def digests(docs: DataFrame) -> DataFrame:
    """The runs of the altered texts as numbers and digests."""
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = repetitions(docs, altered).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) DIV best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
