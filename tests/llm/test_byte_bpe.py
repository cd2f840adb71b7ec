import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from cantiere.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(st.one_of(st.sampled_from(" \n\t'stremvld!a1é² 　\u0085́中😀"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'stremvld!a1é² 　\u0085́中😀"), st.characters(max_codepoint=0x5FF)), max_size=60), max_size=5))
def test_matches_are_those_of_the_pattern(texts):
    assert byte_bpe.pieces(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_ids_and_round_trip(library, text):
    coder, raw = byte_bpe.codec(PATH), text.encode()
    before, one, after = coder.encoded(["x y", text, ""])
    assert np.frombuffer(one.ids, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(one) == raw and coder.decode(before) == b"x y" and coder.decode(after) == b""
    assert coder.offsets(one.ids)[-1] == len(raw) == one.piece_bytes[-1] and 4 * one.piece_ids[-1] == len(one.ids)
    assert coder.offsets(one.ids)[one.piece_ids].tolist() == one.piece_bytes.tolist()


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(0, 90), st.integers(0, 90))
def test_ranges_decode_from_their_pieces(text, start, stop):
    coder = byte_bpe.codec(PATH)
    assert coder.decode(coder.encoded([text])[0], start, stop) == text.encode()[start:stop]


def test_long_pieces_merge_as_short_ones_do(library):
    for text in ("ab" * 4000 + "xyz" * 300, "a" * 5000, "é" * 700, "x" * 47 + "yz"):
        assert np.frombuffer(byte_bpe.codec(PATH).encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_digests_of_tables(documents, odd_documents, library):
    for docs in (documents, odd_documents):
        want = []
        for r in docs.collect():
            ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
            want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(tuple, byte_bpe.digests(docs, PATH).collect()), key=str) == sorted(want, key=str)
    encoded = byte_bpe.encode(odd_documents, PATH).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in encoded)
    cut = {(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(odd_documents, PATH), PATH, 3, 40).collect()}
    assert cut == {(r.doc_id, (r.text or "").encode()[3:40]) for r in odd_documents.collect()}
    assert byte_bpe.digests(documents.limit(0), PATH).count() == 0
