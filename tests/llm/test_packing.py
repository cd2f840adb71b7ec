import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cantiere.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def best_fit(lengths, capacity):
    """Number of sequences of best-fit decreasing, piece by piece."""
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at == len(gaps):
            opened += 1
            insort(gaps, capacity - length)
        else:
            insort(gaps, gaps.pop(at) - length)
    return opened


def check_places(rows, capacity):
    """Pieces lie in their sequences without gap or overlap."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_rounds_equal_best_fit_piece_by_piece():
    rng = random.Random(1)
    for capacity, n in ((10, 50), (64, 400), (1024, 3000), (7, 0)):
        for top in (capacity, capacity // 2 + 1, 3):
            lengths = [rng.randint(1, top) for _ in range(n)]
            steps = packing.rounds(Counter(lengths), capacity)
            assert len({first + k for _, _, first, some, _, _ in steps for k in range(some)}) == best_fit(lengths, capacity)
            assert sum(some * each for _, _, _, some, each, _ in steps) == n


def test_ids_equal_library(library):
    coder = packing.tokenizer(PATH)
    odd = ["", " ", "\n\n x", "don't <|endoftext|> they'll<|endoftext|>", "Ünïcödé 中文 😀  　 12 34½", "a" * 30_000 + " b", " " * 30_000 + "x"]
    marks = ["".join(f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)} {chr(c)}\n" for c in range(k, k + 500)) for k in range(0, 0x3000, 500)]
    for text in odd + marks:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark, documents, odd_documents, library):
    for docs in (documents, odd_documents):
        rows = packing.digests(docs, PATH).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
            first = (len(ids) - 1) % 1024 + 1
            cuts = [0, *range(first, len(ids) + 1, 1024)]
            want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
        used, total = check_places(rows, 1024), sum(r.length for r in rows)
        assert used == best_fit([r.length for r in rows], 1024) and -(-total // 1024) <= used


def test_equal_lengths_in_several_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 7, 1 + id % 16) AS length", "'x' AS part").repartition(9)
    placed = packing.place(rows, 16).collect()
    assert len(placed) == 5000 and check_places(placed, 16) == best_fit([r.length for r in placed], 16)


def test_sequences_hold_their_ids(spark, odd_documents):
    placed = packing.place(packing.pieces(odd_documents, PATH, 64), 64).persist()
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    assert max(r.n_tokens for r in whole.values()) <= 64 and all(4 * r.n_tokens == len(r.ids) for r in whole.values())
    for r in placed.collect():
        assert whole[r.sequence_id].ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids


def test_other_files_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError)):
        packing.FileTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_empty_table(odd_documents):
    assert packing.digests(odd_documents.limit(0), PATH).count() == 0
