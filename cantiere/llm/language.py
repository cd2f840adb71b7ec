"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of byte masks holds the filters of eight languages (more languages, more tables): the AND of a
gram's HASHES slots is the set of all languages that contain it. Per text, the masks' popcounts by language, less
the hits that the fill of each filter lets expect by chance, decide. Grams are ORDERS code points of one
lower-cased word with its edges; a language contains those that are not much rarer in it than elsewhere.

NULL texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learnt. A tie
goes to the language with more learnt rows, then the smaller name. Rows with NULL lang or id are predicted, not learnt;
repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cantiere.llm.common import blocks, id_bucket, mix64, split_sizes

#: The rows of at most so many ids are learnt: those with the smallest hash.
FIT_IDS = 10_000
ORDERS = (3, 4, 5)
SLOTS, HASHES = 1 << 22, 2
#: A language contains a gram only from this share of the gram's largest relative frequency in any language on.
LEAST_SHARE = 0.1
_FACTORS = np.random.default_rng(11).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every order, the gram codes of all texts and the number of the text of each."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = letters()[codes]
    text = np.repeat(np.arange(len(low)), split_sizes(low) + 1)
    text = np.concatenate([[0], text])
    kept = word.copy()
    kept[0] = True
    kept[1:] |= word[:-1]  # one edge behind every word
    codes, word, text = np.where(word, codes, 32)[kept].astype(np.uint64), word[kept], text[kept]
    for n in ORDERS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        inner = word[1:size + 1].copy()
        for i in range(2, n - 1):
            inner &= word[i:size + i]
        at = np.flatnonzero(inner)
        code = np.full(len(at), n, np.uint64)
        for i in range(n):
            code += codes[at + i] * _FACTORS[i]
        yield mix64(code), text[at + 1]


def slots(codes: np.ndarray) -> list[np.ndarray]:
    return [((codes >> np.uint64(24 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    tables: list[np.ndarray]

    def __post_init__(self):
        self.chance = np.array([np.mean(self.tables[i // 8] >> (i % 8) & 1) ** HASHES for i in range(len(self.languages))])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        rows = len(texts)
        hits, total = np.zeros((rows, 8 * len(self.tables))), np.zeros(rows)
        bits = np.arange(256)[:, None] >> np.arange(8) & 1
        for codes, text in grams(texts):
            total += np.bincount(text, minlength=rows)
            places = slots(codes)
            for b, masks in enumerate(self.tables):
                found = masks[places[0]]
                for place in places[1:]:
                    found = found & masks[place]
                hits[:, 8 * b:8 * b + 8] += np.bincount(text * 256 + found, minlength=256 * rows).reshape(rows, 256) @ bits
        if not self.languages:
            return ["und"] * rows, np.zeros(rows)
        true = np.maximum((hits[:, :len(self.languages)] - total[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9), 0)
        best = np.argmax(true, axis=1)
        score = true[np.arange(rows), best] / np.maximum(true.sum(axis=1), 1e-9)
        und = total == 0
        return np.where(und, "und", np.array(self.languages, object)[best]).tolist(), np.where(und, 0.0, score)


def learn(docs: DataFrame, learnable: Column, ids: int = FIT_IDS) -> Filters:
    """Filters from the rows (doc_id, text, lang) of at most ``ids`` ids for which ``learnable`` holds."""
    usable = docs.filter(learnable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    key = [F.xxhash64("doc_id"), F.col("doc_id")]
    # bounded by ``ids`` rows
    sample = usable.join(F.broadcast(usable.select("doc_id").distinct().orderBy(*key).limit(ids)), "doc_id")
    languages = [r.lang for r in sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text"):
            lang = pdf["lang"].map(number).to_numpy(np.int64)
            for codes, text in grams(pdf["text"].tolist()):
                for i in np.unique(lang[text]):
                    code, n = np.unique(codes[lang[text] == i], return_counts=True)
                    yield pd.DataFrame({"gram": code.view(np.int64), "lang": np.full(len(n), i, np.int32), "n": n})

    counted = sample.select("lang", "text").mapInPandas(count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    size = F.create_map(*[F.lit(x) for i, n in totals.items() for x in (i, float(n))]) if totals else None
    tables = []
    if totals:
        shares = counted.withColumn("share", F.col("n") / size[F.col("lang")])
        top = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("each"))  # one entry per language
        inside = top.select("gram", F.explode(F.filter("each", lambda e: e["share"] >= LEAST_SHARE * F.col("top"))["lang"]).alias("lang"))
        for bank in range(-(-len(languages) // 8)):
            mask = inside.filter(F.floor(F.col("lang") / 8) == bank).groupBy("gram").agg(F.bit_or(F.expr("shiftleft(1, lang % 8)")).alias("mask"))
            place = [F.shiftrightunsigned("gram", 24 * i).bitwiseAND(F.lit(SLOTS - 1)) for i in range(HASHES)]
            # at most SLOTS rows
            filled = mask.select(F.explode(F.array(*place)).alias("slot"), "mask").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
            masks = np.zeros(SLOTS, np.uint8)
            masks[filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.uint8)
            tables.append(masks)
    return Filters(languages, tables)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 3 is 1), lang_pred, score."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text"):
            names, score = filters.predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": names, "score": score})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs, id_bucket("doc_id", 3) != 1))
