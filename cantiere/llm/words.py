"""Word hashes of many texts at once, from their bytes."""

from __future__ import annotations

import numpy as np

from cantiere.llm.common import mix64, split_sizes

_RNG = np.random.default_rng(20240502)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODES[65:91] = _BYTE_CODES[97:123]  # A-Z count as a-z
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 2**64)

#: Bytes between words: all of ASCII but letters and digits.
MARKS_AND_WHITE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str], between: np.ndarray = MARKS_AND_WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lower-cased), and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(between[data], prepend=True))  # word starts and ends in turn
    starts, ends = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    words = mix64((total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts])
    last = np.searchsorted(starts, np.cumsum(split_sizes(raw) + 1))
    return words, np.diff(last, prepend=0)
