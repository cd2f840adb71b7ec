"""Token ids as Parquet list columns that can be read selectively.

Documents are range-partitioned by id and encoded in order. A file holds ``part, seq, doc_id, start_in_part,
n_tokens`` beside ``ids array<int>``: a reader that wants lengths or offsets reads no ids. Metadata columns
are delta or dictionary encoded (they rise or repeat), ids dictionary encoded until the dictionary is full, then bit
packed by delta; row groups and pages have a set size, and the page index lets a filter on ``doc_id`` skip
pages. Positions over all files need only one total per part.

This vocabulary drops white space and merges never cross it, so the ids of a text are those of its words (split at ASCII white
space) in order. All texts of a block run through the tiktoken core at once, with the file's merges: what the library's pattern
makes of words of Latin letters, digits and ASCII marks follows from the classes of neighbouring bytes. Other words (apostrophes, other
scripts, very long ones) are encoded by the tokenizers library, once each, and put into their places. The special strings of the
file are cut out of a text first, as the library does, whatever stands beside them.

NULL and empty texts have the end id only. Repeated rows and equal ids each keep a row; their order within
equal ids follows the text. NULL ids come first.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cantiere.llm.common import arrow_blocks, release_memory, split_sizes
from cantiere.session import scratch_dir

#: Cached words of the library per worker; the cache is emptied beyond it.
CACHE_WORDS = 500_000
#: Bytes of text encoded at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: A word that texts hardly hold and that is one token.
MARK = "\x01"
#: What stands for the end of a piece.
END = " "
#: Bytes that stand for the end of a text and for a word of the library, and one that never stands anywhere: words that hold them are odd.
SLOT, KEPT, NEVER = b"\x02", b"\x03", b"\x00"
#: Bytes up to which words are encoded by the core, whose merges are quadratic in a piece.
LONG_WORD = 1000
#: A word of Latin letters, which normalisation leaves alone but for lower case, and marks behind it (asked by tests).
LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: classes of bytes; a word with an odd one is left to the library
WHITE, LETTER, DIGIT, ASCII_MARK, ODD = range(5)


def _class(b: int) -> int:
    if b in b" \t\n\v\f\r":
        return WHITE
    # the letters À to ÿ are C3 and one byte more; × and ÷ (C3 97, C3 B7) are none
    if 128 <= b < 192 and b not in (0x97, 0xB7) or b == 0xC3 or 65 <= b < 91 or 97 <= b < 123:
        return LETTER
    if 48 <= b < 58:
        return DIGIT
    return ASCII_MARK if 32 < b < 127 and b != 39 else ODD  # an apostrophe may begin a contraction


CLASSES = bytes(map(_class, range(256)))
#: Lower case and one kind of white space, for words without odd bytes.
PLAIN = bytes(32 if CLASSES[b] == WHITE else b + 32 if 65 <= b < 91 or 128 <= b < 159 and b != 0x97 else b for b in range(256))
#: fixed values: the letter that stands for each byte in byte-level vocabularies
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = [chr(b) if b in _OWN else chr(256 + b - sum(o < b for o in _OWN)) for b in range(256)]
FILE_SCHEMA = "part int, seq long, doc_id long, start_in_part long, n_tokens long, ids array<int>"
#: Row groups of 16 MB with pages of 256 KB: a page is the unit of a selective read.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        if any(token[flag] for token in told["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: special strings that depend on their neighbours")
        self.special = {token["content"]: token["id"] for token in told["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self._merges(told["model"])
        self.cache: dict[bytes, bytes] = {}
        self.mark = self._ids([MARK])[0]

    def _merges(self, model: dict) -> None:
        """The file's merges for the tiktoken core, which knows no word ends: END stands behind each piece and joins its last
        byte first, by the lowest ranks of all pairs."""
        import tiktoken

        end, vocab = model["end_of_word_suffix"], model["vocab"]
        byte_of = {letter: i for i, letter in enumerate(BYTE_LETTERS)}

        def spelt(token: str) -> bytes:
            stem, closed = (token[:-len(end)], END) if token.endswith(end) else (token, "")
            return bytes(map(byte_of.__getitem__, stem)) + closed.encode()

        ranks, ids = {bytes([i]): i for i in range(256)}, [vocab[c] for c in BYTE_LETTERS]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        for token in [c + end for c in BYTE_LETTERS] + merged:
            ranks[spelt(token)] = len(ids)
            ids.append(vocab[token])
        self.ids = np.array(ids, "<u4")
        self.slot, self.kept = (ranks[b + END.encode()] for b in (SLOT, KEPT))
        # without any special string the core would look for the empty one at every character
        self.core = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={NEVER.decode(): len(ids)})

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Words are encoded as one text with a marker word between them, whose id cuts the result."""
        plain = [w.decode("utf-8", "surrogatepass") for w in words]
        joined = f" {MARK} ".join(plain)
        ids = np.array(self._ids([joined])[0], "<u4")
        cuts = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) != 1 or len(cuts) != len(words) - 1:  # a word holds the marker itself
            return [np.array(one, "<u4").tobytes() for one in self._ids(plain)]
        starts, ends, raw = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)], ids.tobytes()
        return [raw[a:b] for a, b in zip(starts, ends)]

    def _library(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by the library, new ones in groups."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list(set(words).difference(cache))
        for at in range(0, len(new), 512):
            some = new[at:at + 512]
            cache.update(zip(some, self._words(some)))
        return [cache[w] for w in words]

    def _slotted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (without special strings) with a slot behind each text, and the places of the slots."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = bytearray(b" " + (b" " + SLOT + b" ").join([*raw, b""]))
        kinds, plain = (np.frombuffer(data.translate(to), np.uint8) for to in (CLASSES, PLAIN))
        kinds[np.cumsum(split_sizes(raw) + 3) - 1] = ASCII_MARK  # the slots
        # words that the library encodes: each becomes one byte
        white = np.flatnonzero(kinds == WHITE)
        left = np.union1d(np.searchsorted(white, np.flatnonzero(kinds == ODD)), np.flatnonzero(np.diff(white) > LONG_WORD + 1) + 1)
        starts, ends = white[left - 1] + 1, white[left]
        if len(left):
            inside = np.zeros(len(data), np.int8)
            inside[starts], inside[ends] = 1, -1
            inside = np.cumsum(inside, dtype=np.int8).view(bool)
            plain[inside], kinds[inside] = ord(END), WHITE
            plain[starts], kinds[starts] = KEPT[0], ASCII_MARK
        # a piece ends where the class changes and behind each digit
        turns = ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)) & (kinds[1:] != WHITE) & (kinds[:-1] != WHITE)
        stream = np.insert(plain, np.flatnonzero(turns) + 1, ord(END)).tobytes().decode()
        ranks = self.core.encode_to_numpy(stream, disallowed_special=())
        ids, slots = self.ids[ranks], np.flatnonzero(ranks == self.slot)
        if len(left):
            found = self._library([bytes(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
            kept, sizes = ranks == self.kept, np.ones(len(ranks), np.int64)
            sizes[kept] = split_sizes(found) // 4
            ids, slots = np.repeat(ids, sizes), np.cumsum(sizes)[slots] - 1
            ids[np.repeat(kept, sizes)] = np.frombuffer(b"".join(found), "<u4")
        return ids, slots

    def closed(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the number of ids of each text."""
        parts, closing, of = [], [], []
        for i, text in enumerate(texts):
            if any(special in text for special in self.special):
                some, named = self.cut.split(text), [self.special[found] for found in self.cut.findall(text)]
            else:
                some, named = [text], []
            parts += some
            closing += [*named, end_id]
            of += [i] * len(some)
        ids, slots = self._slotted(parts)
        ids[slots] = closing
        lasts = slots[np.flatnonzero(np.diff(of, append=len(texts)))]
        return ids, np.diff(lasts, prepend=-1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, sizes = self.closed(texts, 0)
        raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b - 4] for a, b in zip([0, *ends], ends)]

    _pieces = encode  # words of letters are texts like others


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Encode ``doc_id, text`` and write the files, in ascending doc_id order over parts and rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seq, start = tokenizer(tokenizer_file), 0, 0
        gc.disable()  # nothing here forms cycles, and each search for them passes over all cached words
        try:
            for block in arrow_blocks(batches, "text", BLOCK_BYTES):
                found, sizes = coder.closed([t or "" for t in block["text"].to_pylist()], end_id)
                # one buffer of ids for the whole block
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.Array.from_buffers(pa.int32(), len(found), [None, pa.py_buffer(found)])
                starts = start + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [block["part"], pa.array(np.arange(seq, seq + len(sizes))), block["doc_id"], pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(bounds, ids)],
                    names=["part", "seq", "doc_id", "start_in_part", "n_tokens", "ids"])
                seq, start = seq + len(sizes), int(starts[-1] + sizes[-1])
        finally:
            gc.enable()
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one id may lie on both sides of a range bound only if the bound is finer than the id: the text decides
    keys = ("doc_id", F.xxhash64("text"))
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    sorted_rows = ranged.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    writer = sorted_rows.mapInArrow(run, FILE_SCHEMA).write
    for key, value in LAYOUT.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens: read without touching the ids."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "doc_id", "start_in_part", "n_tokens")
    return rows.join(_part_starts(rows), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The index with the ids."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    starts = _part_starts(rows.select("part", "start_in_part", "n_tokens"))
    return rows.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _part_starts(rows: DataFrame) -> DataFrame:
    """First global position of every part. One row per part, as many as the write had tasks."""
    from pyspark.sql import Window

    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # bounded by the number of write tasks, 16 bytes each
    return F.broadcast(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start")))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            raw, bounds = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B"), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write to a new shared folder, then read the digests back."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "token-files")
    write(docs, tokenizer_file, path, end_id)
    return digests(spark, path)
