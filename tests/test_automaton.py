"""The term automaton against plain containment and against the built-in search."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cantiere.functions import automaton, rules
from cantiere.operators.scale import computed_once
from cantiere.plans import catalog_text

LETTERS = st.text(alphabet="abé€", max_size=6)


def plain(texts, terms):
    return [[t for t in terms if t in (text or "")] for text in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, unique=True, max_size=8), st.lists(st.none() | st.text(alphabet="abé€x", max_size=40), max_size=8))
def test_equals_containment(terms, texts):
    assert automaton.Automaton(terms).found(pa.array(texts, pa.string())).to_pylist() == plain(texts, terms)


def test_windows_blocks_and_slices(monkeypatch):
    """Occurrences over window ends, more windows than a block, a sliced array, texts of very different length."""
    rng = random.Random(3)
    monkeypatch.setattr(automaton, "WINDOW", 7)
    monkeypatch.setattr(automaton, "BLOCK_WINDOWS", 16)
    terms = ["".join(rng.choices("ab", k=rng.randrange(1, 19))) for _ in range(60)]
    terms = list(dict.fromkeys([*terms, "é", "ab" * 12, ""]))
    texts = [None, "", *["".join(rng.choices("abé", [9, 9, 1], k=rng.choice([0, 3, 40, 700]))) for _ in range(50)]]
    got = automaton.Automaton(terms).found(pa.array(texts, pa.string()).slice(1, 45)).to_pylist()
    assert got == plain(texts[1:46], terms)


@pytest.mark.parametrize("terms", [[], [""], ["a"]])
def test_few_terms_and_empty_batches(terms):
    assert automaton.Automaton(terms).found(pa.array([], pa.string())).to_pylist() == []
    assert automaton.Automaton(terms).found(pa.array(["a", None, "b"])).to_pylist() == plain(["a", None, "b"], terms)


def test_long_text():
    text = "x" * 3_000_000 + "needle" + "y" * 2_000_000
    assert automaton.Automaton(["needle", "xxn", "zz"]).found(pa.array([text, "zz"])).to_pylist() == [["needle", "xxn"], ["zz"]]


def test_equals_the_built_in_search(spark, sf):
    docs = catalog_text._docs(spark, sf)
    words = catalog_text.PRESET_WORDS
    both = computed_once(docs, {"one": rules.found_terms(F.col("t"), words), "two": automaton.found_terms(F.col("t"), words)})
    assert both.filter(F.size("one") > 0).count() > 0 and both.filter(~F.col("one").eqNullSafe(F.col("two"))).count() == 0
