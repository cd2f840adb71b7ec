"""Benchmark decontamination: embedded windows, bit-sampling LSH, exact edit verification.

The random-walk embedding maps a word sequence to one of fixed length: step t writes the current word and moves on
if bit t of that word's random bits is set. Sequences at a small edit distance get embeddings at a small Hamming
distance, because two walks that an edit has set apart meet again. Every word of a document starts a window, and
so does every word of an item that is long enough to fill it: windows have the size of the smallest item
taken (MIN_ITEM_WORDS), longer items give one window per word. Independent walks, each with two samples of
SAMPLED positions, are looked up in the items' keys; their number follows from TARGET_RECALL (``walks_needed``). Regions around the hits are verified by the exact edit
distance between the item's words and any stretch of the document. An item is found if it is within
MAX_EDITS of its words.

Words are runs of letters, digits and non-ASCII characters, compared without regard to case by Unicode's folding
(``str.casefold``: upper-casing a text changes no word, but for the dotless i). NULL and blank texts hold
nothing; items with fewer words than MIN_ITEM_WORDS (also NULL ones) identify nothing and are left out. Repeated
rows, ids and items each count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from cantiere.llm.common import blocks, mix64
from cantiere.llm.words import word_hashes

MIN_ITEM_WORDS = 8
#: Largest share of an item's words that edits may concern.
MAX_EDITS = 0.2
#: Share of copies with as many random edits as MAX_EDITS allows that the keys are to reach, for items of any size in TRIAL_WORDS.
TARGET_RECALL = 0.95
TRIAL_WORDS = (8, 9, 10, 11, 12, 13, 14, 15)
TRIALS = 1500
MOST_WALKS = 24
#: Positions of the embedding that one key samples; a walk of 15 steps passes about 8 words.
SAMPLED = ((0, 4, 8, 12), (2, 6, 10, 14))
STEPS = 15
#: Bits that a table of hashes has beyond its number of entries' own, and the most bits of a table.
SPARE_BITS, MOST_BITS = 6, 22
#: Code points of items held by a task; more items are searched group by group.
ITEM_CHARS = 32_000_000
_SEEDS = np.random.default_rng(7).integers(1, 2**63, (MOST_WALKS, 5), dtype=np.uint64)


def padded(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with STEPS empty ones behind every text, so that no walk enters the next text; and the starts of texts."""
    starts = np.concatenate([[0], np.cumsum(sizes + STEPS)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    out = np.zeros(int((sizes + STEPS).sum()), np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(sizes)) * STEPS, sizes)] = words
    return out, starts


def walk_bits(words: np.ndarray, walks: int) -> Iterator[np.ndarray]:
    """The random bits of every word for each walk (bit t: whether step t moves on)."""
    for walk in range(walks):
        if walk % 4 == 0:
            mixed = mix64(words + _SEEDS[walk, 0])
        yield (mixed >> np.uint64(16 * (walk % 4))).view(np.int64)


def walked(bits: np.ndarray, here: np.ndarray, first: int, last: int) -> np.ndarray:
    """Where walks stand that come to ``here`` before step ``first``, before step ``last``."""
    for step in range(first, last):
        move = bits.take(here)
        move >>= step
        move &= 1
        move += here
        here = move
    return here


def keys(words: np.ndarray, at: np.ndarray, walks: int) -> Iterator[list[np.ndarray]]:
    """Sampled embeddings of the windows that start at ``at``, for each sample of each walk: the key of the first two sampled words, and of all."""
    for seeds, bits in zip(_SEEDS, walk_bits(words, walks)):
        for sampled in SAMPLED:
            total, here, before, out = np.zeros(len(at), np.uint64), at, 0, []
            for i, step in enumerate(sampled):
                here, before = walked(bits, here, before, step), step
                total = total + words.take(here) * seeds[1 + i]
                if i in (1, len(sampled) - 1):
                    out.append(mix64(total))
            yield out


def edited(item: list, edits: int, other, rng: np.random.Generator) -> list:
    """The item with words at distinct random places replaced, left out, or followed by another."""
    out = [[word] for word in item]
    for i in rng.choice(len(item), edits, replace=False):
        out[i] = ([], [other()], [*out[i], other()])[rng.integers(3)]
    return [word for part in out for word in part]


@lru_cache
def walks_needed(target: float) -> int:
    """The least number of walks whose keys meet in at least ``target`` of the trials for every item size.

    A trial is an item of random words and a copy with the most edits allowed, between other words. The trials are the same at every
    call, so that all runs search alike.
    """
    rng = np.random.default_rng(11)
    new = lambda: int(rng.integers(1, 2**63))
    most = 1
    for size in TRIAL_WORDS:
        items = rng.integers(1, 2**63, (TRIALS, size)).tolist()
        copies = [[new() for _ in range(9)] + edited(item, int(MAX_EDITS * size), new, rng) + [new() for _ in range(9)] for item in items]
        sides = []
        for lists, last in ((items, MIN_ITEM_WORDS - 1), (copies, 0)):
            sizes = np.array([len(one) for one in lists])
            flat, starts = padded(np.array([w for one in lists for w in one], np.uint64), sizes)
            trial = np.repeat(np.arange(TRIALS), sizes - last)
            at = np.arange(len(trial)) + np.repeat(starts - (np.cumsum(sizes - last) - (sizes - last)), sizes - last)
            sides.append((trial, keys(flat, at, MOST_WALKS)))
        (trial, ours), (where, theirs) = sides
        met = np.zeros(TRIALS, bool)
        for n, ((_, one), (_, two)) in enumerate(zip(ours, theirs)):
            mark = lambda key, of: key ^ mix64(of.astype(np.uint64))
            met[where[np.isin(mark(two, where), mark(one, trial))]] = True
            if met.mean() >= target:
                break
        else:
            raise ValueError(f"{MOST_WALKS} walks do not reach a recall of {target} for items of {size} words")
        most = max(most, n // len(SAMPLED) + 1)
    return most


def nearest(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance between the item and any stretch of the text, and where the first such stretch ends.

    Bit-parallel: one column of the distance table per word, held in two integers.
    """
    m = len(item)
    where: dict[int, int] = {}
    for i, word in enumerate(item):
        where[word] = where.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, end = m, 0
    for i, word in enumerate(text, 1):
        equal = where.get(word, 0)
        across = (((equal & up) + up) ^ up) | equal
        rise = down | (full & ~(across | up))
        fall = up & across
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        along = equal | down
        up, down = fall | (full & ~(along | rise)), rise & along
        if distance < best:
            best, end = distance, i
    return best, end


def folded(texts: list[str]) -> list[str]:
    """The texts without regard to case; folding neither makes nor removes a mark between words."""
    return [t.casefold() for t in texts]


class Seen:
    """Bits of hashes that occur: one that does not is nearly always known from its first bits."""

    def __init__(self, hashes: np.ndarray):
        bits = min(max(len(hashes).bit_length() + SPARE_BITS, 10), MOST_BITS)
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[(hashes >> self.shift).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits.take((hashes >> self.shift).astype(np.int64))


class Items:
    """Keys of all item windows."""

    def __init__(self, ids: list, texts: list[str], target: float = TARGET_RECALL):
        self.walks = walks_needed(target)
        words, sizes = word_hashes(folded(texts))
        cuts = np.cumsum(sizes)
        self.ids, self.words = [], []
        for item, one in zip(ids, np.split(words, cuts[:-1]) if len(cuts) else []):
            if len(one) >= MIN_ITEM_WORDS:
                self.ids.append(item)
                self.words.append(one.tolist())
        flat, starts = padded(np.array([w for one in self.words for w in one], np.uint64), np.array([len(w) for w in self.words], np.int64))
        windows = [(start + i, number, i) for number, (start, one) in enumerate(zip(starts.tolist(), self.words)) for i in range(len(one) - MIN_ITEM_WORDS + 1)]
        at, number, offset = (np.array(c, np.int64) for c in zip(*windows)) if windows else (np.empty(0, np.int64),) * 3
        self.vocabulary = Seen(flat)  # with the empty word behind every item
        self.tables = []
        for pair, key in keys(flat, at, self.walks):
            order = np.argsort(key, kind="stable")
            self.tables.append((Seen(pair), key[order], number[order], offset[order]))

    def hits(self, flat: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (item number, start of the whole item in ``flat``, text of the window) of all windows with an equal key.

        A window is followed only as far as its sampled words can be those of an item's window: an equal key has an item's word at the
        first sampled position and an item's pair at the first two.
        """
        known = self.vocabulary(flat)
        found = [np.empty((0, 3), np.int64)]
        tables = iter(self.tables)
        for seeds, bits in zip(_SEEDS, walk_bits(flat, self.walks)):
            reached, before = at, 0
            for sampled in SAMPLED:
                seen_pairs, sorted_keys, number, offset = next(tables)
                reached, before = walked(bits, reached, before, sampled[0]), sampled[0]
                some = np.flatnonzero(known.take(reached))
                here = reached.take(some)
                total = flat.take(here) * seeds[1]
                for i in range(1, len(sampled)):
                    here = walked(bits, here, sampled[i - 1], sampled[i])
                    fits = np.flatnonzero(known.take(here))
                    some, here, total = some.take(fits), here.take(fits), total.take(fits)
                    total += flat.take(here) * seeds[1 + i]
                    if i == 1:
                        fits = np.flatnonzero(seen_pairs(mix64(total)))
                        some, here, total = some.take(fits), here.take(fits), total.take(fits)
                key = mix64(total)
                low, high = (np.searchsorted(sorted_keys, key, side) for side in ("left", "right"))
                count = high - low
                source = np.repeat(np.arange(len(some)), count)
                entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[source]
                found.append(np.unique(np.column_stack([number[entry], at[some[source]] - offset[entry], row[some[source]]]), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1], pairs[:, 2]

    def search(self, texts: list[str]) -> list[tuple[int, object, int, int, int]]:
        """(row, item_id, distance, words of the item, first word after the stretch) of each item found in each text."""
        if not self.ids:
            return []
        words, sizes = word_hashes(folded(texts))
        flat, starts = padded(words, sizes)
        ends = starts + sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(words)) + owner * STEPS
        number, begin, row = self.hits(flat, at, owner)
        begin = np.maximum(begin, starts[row])  # an item may lack its first words where a text begins
        best: dict[tuple[int, int], tuple[int, int]] = {}
        reach = (-1, -1, -1)  # row, item and end of the stretch of starts already searched
        for r, k, b in sorted(zip(row.tolist(), number.tolist(), begin.tolist())):
            item = self.words[k]
            slack = int(MAX_EDITS * len(item))
            if (r, k) == reach[:2] and b <= reach[2]:
                continue
            low = max(int(starts[r]), b - slack)
            high = min(int(ends[r]), b + len(item) + 2 * slack + STEPS)
            reach = (r, k, b + slack)
            near = flat[low:high].tolist()
            there = set(near)
            if sum(word not in there for word in item) > slack:  # each such word is an edit
                continue
            distance, end = nearest(item, near)
            if distance <= slack:
                old = best.get((r, k))
                if old is None or distance < old[0]:
                    best[r, k] = (distance, low - int(starts[r]) + end)
        return [(r, self.ids[k], d, len(self.words[k]), end) for (r, k), (d, end) in best.items()]


def item_groups(items: DataFrame) -> Iterator[Items]:
    """The items in groups of bounded size; nearly always one."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-chars // ITEM_CHARS))
    for g in range(groups):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g) if groups > 1 else rows
        found = part.orderBy("item_id", "text").collect()  # ITEM_CHARS code points, about
        yield Items([r.item_id for r in found], [r.text for r in found])


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance (edited words), item_words, end_word of every item found in a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for group in item_groups(items):
        one = rows.mapInPandas(_searcher(group), "doc_id long, item_id long, distance int, item_words int, end_word int")
        found = one if found is None else found.union(one)
    return found


def _searcher(group: Items):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text"):
            hits = group.search(pdf["text"].tolist())
            ids = pdf["doc_id"].astype("Int64")
            yield pd.DataFrame({
                "doc_id": ids.iloc[[h[0] for h in hits]].to_numpy(), "item_id": pd.array([h[1] for h in hits], "Int64"),
                **{name: np.array([h[i] for h in hits], np.int32) for i, name in ((2, "distance"), (3, "item_words"), (4, "end_word"))},
            })

    return run


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows in whose text no item is found, with all their columns."""
    for group in item_groups(items):
        docs = docs.filter(~_dirty(group)(F.coalesce(docs["text"], F.lit(""))))
    return docs


def _dirty(group: Items):
    @pandas_udf("boolean")
    def dirty(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, at = np.zeros(len(texts), bool), 0
            for part in blocks([texts.to_frame("text")], "text"):
                out[[at + h[0] for h in group.search(part["text"].tolist())]] = True
                at += len(part)
            yield pd.Series(out)

    return dirty
