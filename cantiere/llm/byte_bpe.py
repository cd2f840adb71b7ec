"""Byte-level BPE: boundaries by a scan of transition functions, cached pair merging, decoding by kept offsets.

Pre-tokenisation gives exactly the matches of the published pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` without a regex: every code point
becomes a symbol (its class and what follows it), every symbol a function state -> state, and since
composing functions is associative, a blocked scan yields the state before every code point of many
texts at once. A table then says whether a match begins there. Matches stay byte ranges of one buffer; where each begins, in bytes and in
ids, is kept beside the ids, so that any range of a text is decoded from the ids of its pieces alone.

NULL and empty texts have no ids; repeated rows and ids are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cantiere.llm.common import arrow_blocks, release_memory, split_sizes

# classes of code points
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
# symbols: a class, refined by the code points that follow
S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_SPACE_LAST, S_BLANK, S_BLANK_LAST, S_APOS_1, S_APOS_2, S_BREAK = range(10)
# states: what the current match is made of, or how many code points of a contraction are due
IN_OTHER, IN_LETTER, IN_NUMBER, IN_BLANK, AFTER_SPACE, DUE_2, DUE_1, FRESH = range(8)

#: fixed values: white space of the pattern's \\s
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Cached pieces per task; the cache is emptied beyond it.
CACHE_PIECES = 100_000
#: Bytes of text encoded at once; a longer text is a block of its own.
BLOCK_BYTES = 250_000
#: Bytes up to which pieces merge together; longer ones merge each with a heap of its own.
LONG_PIECE = 48
#: Code points per row of the blocked scan.
SCAN_WIDTH = 64


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """Class of every code point, by the character tables that the tiktoken library itself uses."""
    import tiktoken

    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        single = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for first in range(0, sys.maxunicode + 1, 1 << 14):  # few at a time: workers have little memory
            points = "".join(chr(c) for c in range(first, min(first + (1 << 14), sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000)
            found = single.encode_to_numpy(points).astype(np.uint8).tobytes()
            out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    out[list(WHITE)] = BLANK
    out[32] = SPACE
    return out


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """step[symbol, state] -> state, begins[symbol, state] -> does a match begin at this code point."""
    step, begins = np.zeros((10, 8), np.uint8), np.zeros((10, 8), bool)
    run = {S_OTHER: IN_OTHER, S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER}
    for state in range(8):
        for symbol in range(10):
            if symbol == S_BREAK:
                step[symbol, state], begins[symbol, state] = FRESH, False
            elif state in (DUE_2, DUE_1):  # inside a contraction
                step[symbol, state] = DUE_1 if state == DUE_2 else FRESH
            elif symbol in run or symbol in (S_APOS_1, S_APOS_2):
                kind = run.get(symbol, IN_OTHER)
                goes_on = state in (kind, AFTER_SPACE)
                begins[symbol, state] = not goes_on
                step[symbol, state] = kind
                if symbol in (S_APOS_1, S_APOS_2) and not goes_on:
                    step[symbol, state] = DUE_1 if symbol == S_APOS_1 else DUE_2
            else:
                last = symbol in (S_SPACE_LAST, S_BLANK_LAST)
                begins[symbol, state] = state != IN_BLANK or last
                step[symbol, state] = AFTER_SPACE if symbol == S_SPACE_LAST else FRESH if symbol == S_BLANK_LAST else IN_BLANK
    return step, begins


STEP, BEGINS = _machine()


def _symbols(codes: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``lasts`` marks the separators behind the texts."""
    kind = code_classes()[codes]
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_BLANK], np.uint8)[kind]
    white = kind >= SPACE
    white[lasts] = True  # white space before the end of a text is not "last": nothing follows it
    inner = np.flatnonzero((kind[:-1] >= SPACE) & ~white[1:])
    out[inner] += 1
    for at in np.flatnonzero(codes == 39):
        two = codes[at + 1:at + 3].tolist() + [0, 0]  # every text ends with a separator, so this stays inside it
        if two[0] in (115, 116, 109, 100):
            out[at] = S_APOS_1
        elif (two[0], two[1]) in ((114, 101), (118, 101), (108, 108)):
            out[at] = S_APOS_2
    out[lasts] = S_BREAK
    return out


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """State before every symbol, starting FRESH, by a scan over composed transition functions."""
    rows = -(-len(symbols) // SCAN_WIDTH)
    grid = np.full(rows * SCAN_WIDTH, S_BREAK, np.uint8)
    grid[:len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, SCAN_WIDTH).T)
    flat = STEP.ravel()
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()  # the function of each row
    for column in grid:
        whole = flat[column[:, None].astype(np.int16) * 8 + whole]
    shift = 1
    while shift < rows:  # composition is associative: prefixes by doubling
        later = np.take_along_axis(whole[shift:], whole[:-shift], axis=1)
        whole = np.concatenate([whole[:shift], later])
        shift *= 2
    state = np.concatenate([[FRESH], whole[:-1, FRESH]]).astype(np.uint8)
    out = np.empty_like(grid)
    for i, column in enumerate(grid):
        out[i] = state
        state = flat[column.astype(np.int16) * 8 + state]
    return out.T.ravel()[:len(symbols)]


def match_bounds(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matches of all texts as byte ranges of one buffer: the buffer, starts, ends, matches per text, byte at which each text begins."""
    sizes = split_sizes(texts)
    joined = "\0".join(texts) + "\0"
    raw = joined.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lasts = np.cumsum(sizes + 1) - 1
    symbols = _symbols(codes, lasts)
    starts = np.flatnonzero(BEGINS.ravel()[symbols.astype(np.int16) * 8 + _states_before(symbols)])
    upto = np.searchsorted(starts, lasts)
    counts = np.diff(upto, prepend=0)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])  # byte at which each code point begins
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = at[starts[1:]]
    some = counts > 0
    ends[upto[some] - 1] = at[lasts[some]]
    return raw, at[starts], ends, counts, at[lasts - sizes]


def pieces(texts: list[str]) -> list[list[str]]:
    """The matches of every text, in order."""
    raw, starts, ends, counts, _ = match_bounds(texts) if texts else (b"", *[np.empty(0, np.int64)] * 4)
    found = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]
    cuts = np.cumsum(counts).tolist()
    return [found[a:b] for a, b in zip([0, *cuts], cuts)]


class Encoded(NamedTuple):
    """Ids (unsigned 32-bit little-endian) of a text, and for each of its pieces, with the end behind the last: the byte at which it begins
    and the number of ids before it."""

    ids: bytes
    piece_bytes: np.ndarray
    piece_ids: np.ndarray


class ByteBpe:
    """Encoder and decoder for a rank file with lines ``base64 rank``."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pair_keys, self.pair_ranks = self._pairs()
        self.cache: dict[bytes, bytes] = {}

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make a token, as sorted keys, and the rank of what they make."""
        ranks, size, keys, made = self.ranks, len(self.bytes_of), [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    made.append(rank)
        order = np.argsort(keys) if keys else np.empty(0, np.int64)
        # a key above all others, so that every search ends inside
        return np.append(np.array(keys, np.int64)[order], size * size), np.append(np.array(made, np.int64)[order], size)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of tokens where it makes none."""
        key = left * len(self.bytes_of) + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.bytes_of))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: the adjacent pair of lowest rank merges first, the leftmost of equals.

        All pieces make one merge in each round; those that have no pair left are done.
        """
        ranks, out, rest = self.ranks, [b""] * len(pieces), []
        for i, piece in enumerate(pieces):
            if (whole := ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = np.array(self._merge_long(piece), "<u4").tobytes()
            else:
                rest.append(i)
        if not rest:
            return out
        none, sizes = len(self.bytes_of), split_sizes([pieces[i] for i in rest])
        token = self.single[np.frombuffer(b"".join([pieces[i] for i in rest]), np.uint8)]
        owner = np.repeat(np.arange(len(rest)), sizes)
        rank = np.full(len(token), none)  # of the pair of each token with the next one
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._rank(token[inner], token[inner + 1])
        while len(token):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(token)))
            done = least == none
            if done.any():
                ended = np.flatnonzero(np.diff(owner[done], prepend=-1))
                raw, cuts = token[done].astype("<u4").tobytes(), (4 * np.append(ended, done.sum())).tolist()
                for k, a, b in zip(owner[done][ended].tolist(), cuts, cuts[1:]):
                    out[rest[k]] = raw[a:b]
                token, owner, rank, least = token[~done], owner[~done], rank[~done], least[~done]
                if not len(token):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]
            token[at] = least[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # whether a token follows is told by its owner below
            token, owner, rank = token[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            for side in (at, at - 1):
                side = side[(side >= 0) & (side < len(token) - 1)]
                side = side[owner[side] == owner[side + 1]]
                rank[side] = self._rank(token[side], token[side + 1])
            ends = at[(at == len(token) - 1) | (owner[at] != owner[np.minimum(at + 1, len(token) - 1)])]
            rank[ends] = none
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap, n log n for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # part i is piece[i:end[i]]; 0 marks a part that has been absorbed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0:
                j = before[i]
                if (r := ranks.get(piece[j:stop])) is not None:
                    heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encoded(self, texts: list[str]) -> list[Encoded]:
        """Every text's ids with the offsets of its pieces; pieces are byte ranges of one buffer."""
        if not texts:
            return []
        raw, starts, ends, counts, begin = match_bounds(texts)
        cache, slices = self.cache, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(cache) > CACHE_PIECES:
            cache.clear()
        new = list(set(slices).difference(cache))
        cache.update(zip(new, self.merge(new)))
        found = list(map(cache.__getitem__, slices))
        n_ids = np.fromiter(map(len, found), np.int64, len(found)) // 4
        out, cuts = [], np.cumsum(counts).tolist()
        for first, last, at in zip([0, *cuts], cuts, begin.tolist()):
            stop = int(ends[last - 1]) if last > first else at
            out.append(Encoded(b"".join(found[first:last]), np.append(starts[first:last], stop) - at, np.append(0, np.cumsum(n_ids[first:last]))))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [one.ids for one in self.encoded(texts)]

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte position at which each token begins in the decoded text, and the total length last."""
        return np.concatenate([[0], np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])])

    def decode(self, one: Encoded, start: int = 0, stop: int | None = None) -> bytes:
        """Bytes ``start`` to ``stop`` of the text, from the ids of the pieces that hold them."""
        at, n = one.piece_bytes, int(one.piece_bytes[-1])
        start, stop, _ = slice(start, stop).indices(n)
        if start >= stop:
            return b""
        first, last = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, stop, "left"))
        ids = np.frombuffer(one.ids, "<u4")[one.piece_ids[first]:one.piece_ids[last]]
        found = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if len(found) != at[last] - at[first]:
            raise ValueError("ids and offsets do not belong together")
        return found[start - int(at[first]):stop - int(at[first])]


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, rank_file: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian), the sha256 of them and of the bytes decoded from them.

    With ``offsets`` also the byte at which each piece begins and the ids before it (unsigned 32-bit little-endian, the end of the
    text last), by which :meth:`ByteBpe.decode` reads any range.  Every executor must be able to read ``rank_file``.
    """
    def columns(coder: ByteBpe, found: list[Encoded]) -> dict:
        out = {"ids": pa.array([one.ids for one in found], pa.binary()), **_digests(coder, found)}
        if offsets:
            out |= {name: pa.array([getattr(one, name).astype("<u4").tobytes() for one in found], pa.binary()) for name in ("piece_bytes", "piece_ids")}
        return out

    kinds = "ids binary, ids_sha256 string, decoded_sha256 string" + (", piece_bytes binary, piece_ids binary" if offsets else "")
    return _mapped(docs, rank_file, doc_id, text, kinds, columns)


def decode(encoded: DataFrame, rank_file: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id and the bytes ``start`` to ``stop`` of each text, from the rows of :func:`encode`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(rank_file)
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("ids", "piece_bytes", "piece_ids")))
            found = [coder.decode(Encoded(ids, np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)), start, stop) for ids, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids", "piece_bytes", "piece_ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, rank_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the sha256 of ids and decoded bytes, without moving the ids out of the task."""
    return _mapped(docs, rank_file, doc_id, text, "ids_sha256 string, decoded_sha256 string", _digests)


def _digests(coder: ByteBpe, found: list[Encoded]) -> dict:
    return {"ids_sha256": pa.array([hashlib.sha256(one.ids).hexdigest() for one in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(coder.decode(one)).hexdigest() for one in found], pa.string())}


def _mapped(docs: DataFrame, rank_file: str, doc_id: str, text: str, kinds: str, columns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(rank_file)
        for block in arrow_blocks(batches, "text", BLOCK_BYTES):
            found = coder.encoded([t or "" for t in block["text"].to_pylist()])
            n = pa.array([len(one.ids) // 4 for one in found], pa.int64())
            more = columns(coder, found)
            yield pa.RecordBatch.from_arrays([block["doc_id"], n, *more.values()], names=["doc_id", "n_tokens", *more])
        coder.cache.clear()  # the worker lives on beside others; the next task learns its own words
        release_memory()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
