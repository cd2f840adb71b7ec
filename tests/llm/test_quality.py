from collections import Counter

import numpy as np
import pytest

from cantiere.llm import quality
from cantiere.llm.common import table


def brute(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def forest(spark, sf, documents):
    return quality.train(documents, table(spark, sf, "labels"))


def test_counts_equal_plain_python(documents, odd_documents):
    texts = [r.text for df in (documents, odd_documents) for r in df.select("text").collect()] + ["a b c d e " * 9, "x\n\nx\n x\nx", "é\x0bé\x1cé"]
    found = quality.counts([t or "" for t in texts])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert list(found[names].itertuples(index=False, name=None)) == [brute(t) for t in texts]


def test_score_never_rises_along_constrained_statistics(forest):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality.FEATURES))) * np.array([8, 9, 2, 1, 1, 1, 0.3, 1, 1, 50])
    for j, direction in enumerate(quality.FEATURES.values()):
        if direction:
            more = x.copy()
            more[:, j] += rng.random(300)
            assert (direction * (forest.score(more) - forest.score(x)) >= 0).all()


def test_trees_as_arrays_equal_a_walk(forest):
    x = np.random.default_rng(2).random((50, len(quality.FEATURES)))
    for row, score in zip(x, forest.score(x)):
        margin = forest.start
        for tree in range(len(forest.feature)):
            node = 0
            while forest.feature[tree, node] >= 0:
                node = 2 * node + 1 + (row[forest.feature[tree, node]] > forest.bound[tree, node])
            margin += forest.value[tree, node]
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-12


def test_labels_are_learnt(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    forest = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.assess(docs, forest).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_odd_rows(odd_documents, forest):
    rows = {(r.doc_id, r.n_words): r for r in quality.assess(odd_documents, forest).collect()}
    assert rows[(1, 0)].base_failed and not rows[(1, 0)].kept
    assert not any(r.kept for r in rows.values() if r.base_failed)
    kept = quality.keep_good(odd_documents, None)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} == {7, 8, 10, 11}


def test_empty_tables_and_missing_labels(spark, sf, documents):
    labels = table(spark, sf, "labels")
    assert quality.train(documents, labels.limit(0)) is None
    assert quality.train(documents.limit(0), labels) is None
    assert quality.assess(documents.limit(0), None).count() == 0
    assert all(r.kept != r.base_failed for r in quality.assess(documents, None).collect())
