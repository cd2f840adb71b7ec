import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from cantiere.llm import token_files
from cantiere.session import scratch_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(docs, library):
    """Rows by plain Python, in the order of the files: NULL ids first, equal ids in any order."""
    return {(r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect()}


def test_words_encode_like_whole_texts(library):
    for text in ("don't they'LL say...", "\x01 a\x01b \x01", "Ünḯ ÉÉ, ΣΑΣ! 12.5 <|endoftext|>", "hello <|endoftext|> world", "in<|endoftext|>side<|startoftext|><|endoftext|>",
                 "<|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "a\n<|startoftext|>\tb. <|endoftext|>", "end. End! end?! (end). a.b,c", " x　y\u0085z", ""):
        assert np.frombuffer(token_files.tokenizer(PATH).encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_word_of_letters_encodes_like_the_library(documents, library):
    """The tiktoken core with the file's merges, against the library, on all words of the documents and random ones."""
    rng, coder = random.Random(4), token_files.tokenizer(PATH)
    words = {w.lower() for r in documents.select("text").collect() for w in (r.text or "").split() if token_files.LATIN.fullmatch(w) and w.isalpha()}
    letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()] + list("etaoinshrdlucmfwypvbgkjqxz" * 3)
    words |= {"".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(20_000)} | {"the" * 50}
    words = sorted(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder._pieces(words)] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_letters_digits_and_marks_pass_the_core_at_once(documents, library):
    """Only other words ask the library and are remembered; before, every distinct word was."""
    rng, coder = random.Random(5), token_files.WordTokenizer(PATH)
    marks = [chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]
    plain = ["The cat, 12.5 $$$ (sat)! ÉÀß_x7", *("".join(rng.choices(["a", "Né", "the", "7", " ", "\n"] + marks, k=rng.randint(0, 40))) for _ in range(3000))]
    odd = ["don't", "\x02", "\x00", "a\x03b", "a×b", "中文", "e\u0301", "x" * 1001, "ab," * 334]
    for some, asked in ((plain, 0), ([x for pair in zip(plain, odd) for x in (pair[0] + " ", f"a {pair[1]} b. {pair[1]}")], len(odd))):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert len(coder.cache) == asked
    texts = [r.text or "" for r in documents.collect()]
    ids, sizes = coder.closed(texts, 1)
    assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in (*e.ids, 1)] and sizes.sum() == len(ids)


def test_files_hold_all_rows_in_order(spark, documents, odd_documents, library):
    for docs in (documents, odd_documents):
        path = scratch_dir(spark, "tokens")
        token_files.write(docs, PATH, path, partitions=3)
        rows = token_files.read_tokens(spark, path).orderBy("start").collect()
        assert {(r.doc_id, tuple(r.ids)) for r in rows} == want(docs, library) and len(rows) == docs.count()
        assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) for r in rows])[:-1].tolist()]
        ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
        assert ids == sorted(ids)
        crc = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, path).collect())
        assert crc == [(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows]
        assert sorted(map(tuple, token_files.read_index(spark, path).collect()), key=str) == sorted(((r.doc_id, r.start, r.n_tokens) for r in rows), key=str)


def test_layout_and_selective_reads(spark, documents, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write(documents, PATH, path, partitions=1)
    meta = pq.ParquetFile(next((tmp_path / "tokens").glob("*.parquet"))).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "ids.list.element" in columns and all(c.has_offset_index and c.has_column_index for n, c in columns.items() if "." not in n)
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert any("DELTA_BINARY_PACKED" in e for n in ("seq", "start_in_part", "doc_id") for e in columns[n].encodings)
    plan = token_files.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan


def test_empty_table(documents):
    assert token_files.round_trip(documents.limit(0), PATH).count() == 0
