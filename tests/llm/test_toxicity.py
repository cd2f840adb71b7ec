import random
import zlib

import numpy as np
import pytest

from cantiere.llm import toxicity
from cantiere.llm.common import table


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network([b"aa", b"bb"], 0)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    windows, labels, weights = [[b"aa", b"xyz", b"q"], [b"bb", b"aa"], [b"longer"]], np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    _, grads = net.gradients(windows, labels, weights)
    for name, value in net.p.items():
        at = np.unravel_index(np.argmax(abs(grads[name])), value.shape)
        kept, losses = value[at], []
        for step in (1e-2, -1e-2):
            value[at] = kept + step
            losses.append(net.gradients(windows, labels, weights)[0])
        value[at] = kept
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 2e-3


def test_windows_cover_every_word_and_overlap():
    for n in (1, 5, 31, 32, 33, 48, 49, 200):
        starts = list(toxicity.window_starts(n))
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))
    assert not list(toxicity.window_starts(0))
    assert b"".join(toxicity.words_of("x" * 77 + " Ab,cé")) == b"x" * 77 + b"ab" + "cé".encode()


def test_windows_score_alike_alone_and_together():
    net, rng = toxicity.Network([b"w1", b"w2"], 3), random.Random(2)
    texts = [[f"w{rng.randrange(40)}".encode() for _ in range(n)] for n in (0, 3, 32, 100, 1, 77)]
    together, number = net.window_logits(texts)
    alone = [net.window_logits([[*t[s:s + toxicity.WINDOW]]])[0][0] for t in texts for s in toxicity.window_starts(len(t))]
    assert number.sum() == len(together) and np.allclose(together, alone, atol=1e-4)


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    net = toxicity.train(docs, labels, rows=3000)
    docs = docs.join(labels, "doc_id", "left_semi")
    return toxicity.score(docs, net).collect(), {r.doc_id: r.toxic for r in labels.collect()}, docs.count()


def test_held_out_labels(scored):
    rows, labels, n = scored
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    one, zero = [p for y, p in held if y], [p for y, p in held if not y]
    assert np.mean(one) > 0.85 and np.mean(zero) < 0.02


def test_a_word_family_is_learnt_from_its_beginning():
    rng = random.Random(4)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    texts, labels = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randrange(20, 200))]
        if i % 4 == 0:
            for at in rng.sample(range(len(words)), 3):
                words[at] = "zux" + word()
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    net = toxicity.fit(texts[:400], np.array(labels[:400]))
    assert np.mean((net.scores(texts[400:]) >= 0.3) == np.array(labels[400:], bool)) > 0.95


def test_odd_rows_and_empty_tables(spark, odd_documents, scored):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (10, 0), (1, 0), (11, 1)], "doc_id long, toxic int").selectExpr("*", "'x' AS text", "1 AS score")
    rows = toxicity.assess(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id == 5}
    assert len(same) == 1
    assert {r.score for r in toxicity.assess(odd_documents, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.assess(odd_documents, labels.filter("doc_id = 4")).collect()} <= {0.0, 1.0}
    assert toxicity.assess(odd_documents.limit(0), labels).count() == 0
