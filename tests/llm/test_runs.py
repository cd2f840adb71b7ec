import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cantiere.llm import lce, runs


def plain_runs(words):
    """Every maximal stretch of every period, kept where no smaller period has the same stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{e},{q}\n" for s, e, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 5, 200])
def test_extensions(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 20, 21, 22, 300):
        codes = rng.integers(0, letters, n)
        extend = lce.Extensions(codes)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(n) if max(a, b) + k == n or codes[a + k] != codes[b + k]), 0) for a, b in zip(i.tolist(), j.tolist())]
        assert extend(i, j).tolist() == want


def test_runs_equal_plain_search():
    rng = random.Random(3)
    texts = [[rng.randrange(k) for _ in range(rng.choice([0, 1, 5, 6, 40, 150]))] for k in (1, 2, 2, 3, 50) for _ in range(25)]
    for _ in range(60):  # repeats of random words, some with a changed word, one behind another
        text = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
            text += (unit * 9)[:rng.randint(len(unit), 8 * len(unit))]
        texts.append(text)
    sizes = np.array([len(t) for t in texts])
    found = [[] for _ in texts]
    for k, *run in zip(*(x.tolist() for x in runs.find_runs(np.array([w for t in texts for w in t]), sizes))):
        found[k].append(tuple(run))
    assert found == [plain_runs(t) for t in texts]


def test_pairs_in_small_portions(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 3)
    codes = np.array([1, 2] * 10 + [3] + [4] * 7)
    assert [x.tolist() for x in runs.find_runs(codes, np.array([28]))] == [[0, 0], [0, 21], [20, 7], [2, 1]]


def test_documents_equal_plain_search(documents, odd_documents):
    short = documents.filter("n_chars < 3000")
    assert runs.digests(short).filter("n_runs > 0").count() > 5
    for docs in (short, odd_documents.filter("doc_id IS NULL OR doc_id NOT IN (7, 8)")):
        got = sorted(map(tuple, runs.digests(docs).collect()), key=repr)
        assert got == sorted((plain_digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)


def test_long_texts_and_spans(spark):
    text = "start " + "a b c " * 40_000 + "x " * 7 + "end"
    row = runs.repetitions(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in row[0].runs] == [(1, 120_000, 3), (120_001, 7, 1)] and row[0].collapsed == "start a b c x end"
    assert row[1].n_words == 0 and row[1].runs == [] and row[1].collapsed == ""


def test_ties_take_the_first(spark):
    row = runs.digests(spark.createDataFrame([(2, "a a a a a a x b b b b b b")], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 0, 6, 1, 6000)


def test_empty_table(odd_documents):
    assert runs.digests(odd_documents.limit(0)).count() == 0
