"""Term search by an automaton: one pass over a text, whatever the number of terms.

The terms form an Aho-Corasick automaton over their UTF-8 bytes, kept as a full transition table (states x byte classes; bytes
in no term share class 0), so that a step is one table look-up. A batch of texts is cut into windows of WINDOW bytes that
also see the first bytes of the next one, as many as the longest term has but one: every occurrence lies in the
window where it begins, and all windows take their steps together as numpy vectors. Work and memory thus depend on
the bytes of a block, not on the longest text or the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 256
#: Windows that step together: 16 MB of text.
BLOCK_WINDOWS = 1 << 16


class Automaton:
    """Transition table, and for each state the terms that end there (also those that are the end of another)."""

    def __init__(self, terms: Sequence[str]):
        self.terms = pa.array(list(terms), pa.string())
        words = [t.encode() for t in terms]
        self.longest = max(map(len, words), default=0)
        self.always = np.array([i for i, w in enumerate(words) if not w], np.int64)
        letters = sorted({b for w in words for b in w})
        self.classes = np.zeros(256, np.int64)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, word in enumerate(words):
            state = 0
            for byte in word:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    ends.append([])
                state = children[state][byte]
            if word:
                ends[state].append(i)
        table = np.zeros((len(children), len(letters) + 1), np.int32)
        level, back = [0], [0] * len(children)
        while level:  # breadth first: a state's row is that of its longest proper suffix, but for its own children
            deeper = []
            for state in level:
                if state:
                    table[state] = table[back[state]]
                    ends[state] = ends[state] + ends[back[state]]
                for byte, child in children[state].items():
                    cls = self.classes[byte]
                    back[child] = int(table[back[state], cls]) if state else 0
                    deeper.append(child)
                for byte, child in children[state].items():
                    table[state, self.classes[byte]] = child
            level = deeper
        self.width = table.shape[1]
        # states are kept multiplied by the width: the next one is step[state + class]
        self.step = (table * self.width).ravel()
        self.accepts = np.repeat(np.array([bool(e) for e in ends]), self.width)
        self.ends_at = np.cumsum([0] + [len(e) for e in ends])
        self.ends = np.array([i for e in ends for i in e], np.int64)

    def _reached(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, accepting states) step by step; windows come longest first."""
        state = np.zeros(len(start), np.int64)
        running = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for offset, n in enumerate(running):  # the first n windows are longer than the offset
            state[:n] = self.step[state[:n] + self.classes[data[start[:n] + offset]]]
            hit = np.flatnonzero(self.accepts[state[:n]])
            if len(hit):
                yield hit, state[hit] // self.width

    def search(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of every term in a text, once each, in order; text i is data[bounds[i]:bounds[i + 1]]."""
        n = len(bounds) - 1
        found = [np.repeat(np.arange(n), len(self.always)) * len(self.terms) + np.tile(self.always, n)]
        size = np.diff(bounds)
        windows = -(-size // WINDOW)
        text = np.repeat(np.arange(n), windows)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = bounds[text] + nth * WINDOW
        length = np.minimum(WINDOW + max(self.longest - 1, 0), bounds[text + 1] - start)
        for low in range(0, len(text) if self.longest else 0, BLOCK_WINDOWS):
            part = low + np.argsort(-length[low:low + BLOCK_WINDOWS], kind="stable")
            keys, held = [], 0
            states = len(self.ends_at) - 1
            for hit, state in self._reached(data, start[part], length[part]):
                keys.append(text[part[hit]] * states + state)
                held += len(hit)
                if held > BLOCK_WINDOWS * 16:  # a state a text is enough
                    keys = [np.unique(np.concatenate(keys))]
                    held = 0
            if keys:
                pairs = np.unique(np.concatenate(keys))
                who, state = pairs // states, pairs % states
                first, n_ends = self.ends_at[state], self.ends_at[state + 1] - self.ends_at[state]
                at = np.arange(n_ends.sum()) + np.repeat(first - (np.cumsum(n_ends) - n_ends), n_ends)
                found.append(np.unique(np.repeat(who, n_ends) * len(self.terms) + self.ends[at]))
        both = np.unique(np.concatenate(found))
        return both // max(len(self.terms), 1), both % max(len(self.terms), 1)

    def found(self, texts: pa.Array) -> pa.Array:
        """List of the terms in each text, in the order of the terms; NULL is the empty text."""
        texts = texts.fill_null("").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        text, term = self.search(data, bounds)
        offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), self.terms.take(pa.array(term)))


@lru_cache(maxsize=16)
def automaton(terms: tuple[str, ...]) -> Automaton:
    """The automaton of a list of distinct terms, built once per worker."""
    return Automaton(terms)


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """Array of the terms inside the text, as :func:`cantiere.functions.rules.found_terms`, in one pass over it."""
    words = tuple(dict.fromkeys(terms))

    @F.arrow_udf("array<string>")
    def search(texts: pa.Array) -> pa.Array:
        return automaton(words).found(texts)

    return search(text)
