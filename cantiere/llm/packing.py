"""Best-fit packing of token pieces into sequences, in bulk rounds.

Texts become tokens and an end id; longer ones are cut into pieces of the capacity, the first one
being what is left over. Pieces are range-sorted by length, largest first, and numbered within their length by one
total per range. A round takes all pieces of one length: they look for their successor among the sorted gaps, the
smallest gap that holds them. Conflicts are resolved by rank: the k-th piece of the length takes the k-th place such gaps offer;
what finds none opens new sequences. Then the gaps are updated and the next length follows. This is best-fit
decreasing, whole: the order of equal pieces does not matter.

Sequences with the same gap are interchangeable, so gaps are kept as runs of consecutive sequence numbers, and pieces of the same
length as a count: the state of all rounds is bounded by the capacity, not by the documents. The driver sees one
count per length and range (at most capacity + ranges rows) and sends back the steps, by which every task places its pieces:
a successor search by (length, rank).

NULL and empty texts are the end id only. Repeated rows and equal or NULL ids are rows of their own. Other columns are
ignored by ``pieces``; ``place`` keeps the columns it is given.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cantiere.llm.common import arrow_blocks, landed, release_memory
from cantiere.llm.token_files import BYTE_LETTERS

#: Tokens of a sequence, and the id behind each document.
CAPACITY, END_ID = 1024, 2
#: Bytes of text encoded at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Texts with a longer stretch of only white space or of none are encoded by the tokenizers library, whose merges stay n log n.
UNBROKEN = 20_000
SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


class FileTokenizer:
    """Ids of a byte-level BPE file of the tokenizers library, computed by the tiktoken core with the same merges.

    Their published pattern and special strings are the same; tests compare the ids. Files of another kind are refused.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told["pre_tokenizer"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = [model["vocab"][a + b] for a, b in merges]
        plain = all(not token[flag] for token in told["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or ranks != sorted(ranks) or told["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not plain:
            raise ValueError(f"{path} is no plain byte-level BPE whose ids rise with its merges")
        byte_of = {letter: i for i, letter in enumerate(BYTE_LETTERS)}
        special = {token["content"]: token["id"] for token in told["added_tokens"]}
        vocabulary = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if len(text) > UNBROKEN and _unbroken(text) > UNBROKEN:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.core.encode_to_numpy(text, allowed_special="all")


def _unbroken(text: str) -> int:
    """Longest stretch of bytes that are all ASCII white space, or all not."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    turns = np.flatnonzero(np.diff((data == 32) | ((data >= 9) & (data <= 13)))) + 1
    return int(np.diff(turns, prepend=0, append=len(data)).max())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> FileTokenizer:
    return FileTokenizer(path)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece (from 0), start (ids of the document before it), length, ids (unsigned 32-bit little-endian).

    Every executor must be able to read ``tokenizer_file``.
    """
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(tokenizer_file)
        for block in arrow_blocks(batches, "text", BLOCK_BYTES):
            ids = [x for text in block["text"].to_pylist() for x in (coder.encode(text or ""), end)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)).reshape(-1, 2).sum(axis=1)
            n = -(-sizes // capacity)
            row, piece = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = (sizes[row] - 1) % capacity + 1
            length = np.where(piece == 0, first, capacity)
            bounds = pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32))
            data = pa.Array.from_buffers(pa.binary(), len(row), [None, bounds, pa.py_buffer(np.concatenate(ids).astype("<u4"))])
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            yield pa.RecordBatch.from_arrays([block["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data],
                                             names=["doc_id", "piece", "start", "length", "ids"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over lengths: (length, first rank, first sequence, sequences, pieces in each, offset).

    ``counts``: pieces of each length. A gap of g takes g // length pieces before another one fits better. The gaps
    stay sorted; each is (gap, first sequence, sequences).
    """
    steps, gaps, opened = [], [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, (length, 0, 0))
            if at == len(gaps):  # no successor: new sequences for all that is left
                each = capacity // length
                insort(gaps, (capacity, opened, -(-left // each)))
                opened += -(-left // each)
                continue
            gap, first, some = gaps.pop(at)
            each = gap // length
            whole = min(some, left // each)
            for take, per in ((whole, each), (1, left % each if whole < some else 0)):
                if take and per:
                    steps.append((length, rank, first, take, per, capacity - gap))
                    insort(gaps, (gap - per * length, first, take))
                    rank, left, first, some = rank + take * per, left - take * per, first + take, some - take
            if some:
                insort(gaps, (gap, first, some))
    return steps


def place(rows: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """The rows with ``sequence_id, offset``; lengths are from 1 to ``capacity``. No row is moved for it but by the range sort."""
    for name in ("_seq", "_base"):
        if name in rows.columns:
            raise ValueError(f"column {name} is taken")
    spark = rows.sparkSession
    keys = [F.desc(length), *(F.asc(c) for c in rows.columns if c != length and dict(rows.dtypes)[c] in ("bigint", "int"))]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(F.desc(length)).withColumn("_seq", F.monotonically_increasing_id())
    ranged = landed(spark, ranged, "lengths")  # a number must not change on a retry
    part, within = F.shiftright("_seq", 33), F.col("_seq").bitwiseAND((1 << 33) - 1)
    found = ranged.groupBy(part.alias("part"), F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n"), F.min(within).alias("first")).collect()
    ahead, bases = Counter(), []  # ranges follow one another, so do the ranks of a length that lies in several
    for r in sorted(found, key=lambda r: r.part):
        bases.append((r.part, r.length, ahead[r.length] - r.first))
        ahead[r.length] += r.n
    base = spark.createDataFrame(bases, "_part long, _length long, _base long")
    steps = np.array(rounds(ahead, capacity), np.int64).reshape(-1, 6)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    key = steps[:, 0] << 44 | steps[:, 1]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def successor(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rank = rank.to_numpy(np.int64)
        one = steps[np.searchsorted(key, size.to_numpy(np.int64) << 44 | rank, "right") - 1]
        k = rank - one[:, 1]
        return pd.DataFrame({"sequence_id": one[:, 2] + k // one[:, 4], "offset": one[:, 5] + k % one[:, 4] * one[:, 0]})

    # one row per length and range: at most capacity + ranges
    ranked = ranged.join(F.broadcast(base), (part == F.col("_part")) & (F.col(length) == F.col("_length")))
    placed = ranked.withColumn("_at", successor(F.col(length).cast("long"), within + F.col("_base")))
    return placed.select(*rows.columns, "_at.sequence_id", "_at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids of each sequence, from pieces with ``ids``; a group is one sequence of at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Every piece with its place and the crc32 of its ids."""
    cut = pieces(docs, tokenizer_file).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(landed(docs.sparkSession, cut, "pieces"))
