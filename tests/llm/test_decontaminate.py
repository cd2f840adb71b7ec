import random
import re

import numpy as np
import pytest

from cantiere.llm import decontaminate
from cantiere.llm.common import table


def words_of(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_distance(item, text):
    """Least edit distance between the item and any stretch of the text, by the full table."""
    row = np.arange(len(item) + 1)
    best = row[-1]
    for word in text:
        new = np.zeros_like(row)
        for i, w in enumerate(item, 1):
            new[i] = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (w != word))
        row = new
        best = min(best, row[-1])
    return int(best)


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return table(spark, sf, "benchmark")


def test_distance_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 20))]
        text = [rng.randrange(6) for _ in range(rng.randrange(40))]
        assert decontaminate.nearest(item, text)[0] == brute_distance(item, text)


def test_items_in_documents_equal_brute_force(spark, documents, benchmark):
    items = [(r.item_id, words_of(r.text)) for r in benchmark.collect()]
    want = set()
    for r in documents.collect():
        text = words_of(r.text)
        near = set(text)
        for item_id, item in items:
            if len(near & set(item)) >= 0.5 * len(set(item)):  # else more than a fifth must be edited
                d = brute_distance(item, text)
                if d <= decontaminate.MAX_EDITS * len(item):
                    want.add((r.doc_id, item_id, d))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminations(documents, benchmark).collect()}
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.keep_clean(documents, benchmark).collect()}
    assert kept == {r.doc_id for r in documents.collect()} - {d for d, _, _ in want}


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15])
def test_recall_of_edited_copies(benchmark, share):
    rng = random.Random(3)
    rows = [(r.item_id, r.text) for r in benchmark.collect()]
    items = decontaminate.Items(*map(list, zip(*rows)))
    filler = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = []
    for _, text in rows:
        words = text.split()
        for i in rng.sample(range(len(words)), int(share * len(words))):
            words[i] = rng.choice(["", rng.choice(filler), words[i] + " " + rng.choice(filler)])
        texts.append(" ".join(rng.choices(filler, k=80) + words + rng.choices(filler, k=80)))
    found = {(h[0], h[1]) for h in items.search(texts)}
    assert np.mean([(i, item) in found for i, (item, _) in enumerate(rows)]) > 0.95
    assert all(rows[i][0] == item for i, item in found)


def test_odd_rows_and_items(spark, odd_documents):
    items = spark.createDataFrame(
        [(1, "B C D e f g h, i j k! l m n"), (1, "B C D e f g h, i j k! l m n"), (2, None), (3, ""), (4, "too short"),
         (None, "null id with a few words in it")], "item_id long, text string").selectExpr("*", "1 AS doc_id", "1 AS distance")
    rows = decontaminate.contaminations(odd_documents, items).collect()
    assert sorted({(r.doc_id, r.item_id, r.distance) for r in rows}, key=str) == [(10, 1, 0), (11, 1, 0), (None, None, 0)]
    kept = decontaminate.keep_clean(odd_documents, items)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 5, 7, 8, 9, 9]


def test_groups_of_items_and_empty_tables(monkeypatch, documents, benchmark):
    whole = {tuple(r) for r in decontaminate.contaminations(documents, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 2000)
    assert {tuple(r) for r in decontaminate.contaminations(documents, benchmark).collect()} == whole
    assert decontaminate.contaminations(documents, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminations(documents.limit(0), benchmark).count() == 0
    assert decontaminate.keep_clean(documents, benchmark.limit(0)).count() == documents.count()


def folded_words(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").casefold())


def test_upper_cased_copies_are_found(spark):
    given = ["Über die Straße läuft ein großer Bär, während die Vögel schön über dem Fluß kreisen und Öl verbrennt",
             "ο γρήγορος κόσμος της θάλασσας είναι μεγάλος και ο ουρανός μένει ήσυχος πάνω από τους δρόμους",
             "быстрая лиса прыгает через ленивую собаку пока дождь идёт над тихой рекой у старого дома"]
    items = spark.createDataFrame(list(enumerate(given)), "item_id long, text string")
    filler = "Ein Wort davor und noch viele andere mehr "
    rows = [(i, filler + fold(t) + " " + filler) for i, t in enumerate(given) for fold in (str.upper, str.title, str.lower)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contaminations(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(i, i, 0) for i in range(3) for _ in range(3)]
    assert decontaminate.keep_clean(docs, items).count() == 0


def test_items_in_documents_equal_brute_force_without_case(spark):
    """The documents of the larger table that hold upper-cased copies, beside a two-hundredth of the others."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("doc_id IN (1699, 6420) OR doc_id % 200 = 0")
    given = table(spark, "/root/testdata/sf0.1", "benchmark")
    items = [(r.item_id, folded_words(r.text)) for r in given.collect()]
    want = set()
    for r in docs.collect():
        text = folded_words(r.text)
        near = set(text)
        for item_id, item in items:
            if len(near & set(item)) >= 0.5 * len(set(item)):
                d = brute_distance(item, text)
                if d <= decontaminate.MAX_EDITS * len(item):
                    want.add((r.doc_id, item_id, d))
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminations(docs, given).collect()} == want
    assert {(1699, 130, 0), (6420, 37, 0)} <= want


def test_item_without_its_first_words_at_the_start_of_a_later_text():
    item = [f"i{k}" for k in range(100)]
    items = decontaminate.Items([1], [" ".join(item)])
    text = " ".join(item[18:])
    other = " ".join(f"o{k}" for k in range(300))
    for texts in ([text], [other, text], [other, "", text, other], [text, text]):
        assert {(h[0], h[2]) for h in items.search(texts)} == {(i, 18) for i, t in enumerate(texts) if t == text}


@pytest.mark.parametrize("size", [8, 9, 10, 12, 15, 30, 60])
def test_recall_of_short_items_with_all_edits_allowed(size):
    """Items of random words, each copy with a fifth of its words edited: nine of ten are found, and none that is not there."""
    rng = np.random.default_rng(100 + size)
    word = lambda: f"w{rng.integers(20000)}"
    given = [[word() for _ in range(size)] for _ in range(400)]
    items = decontaminate.Items(list(range(400)), [" ".join(one) for one in given])
    texts = [" ".join([word() for _ in range(60)] + decontaminate.edited(one, int(0.2 * size), word, rng) + [word() for _ in range(60)]) for one in given]
    found = [(h[0], h[1]) for h in items.search(texts)]
    assert all(row == item for row, item in found) and len(found) > 0.9 * len(given)


def test_walks_follow_the_target():
    walks = [decontaminate.walks_needed(target) for target in (0.5, 0.8, 0.95)]
    assert 0 < walks[0] < walks[1] < walks[2] == decontaminate.Items([], []).walks
    with pytest.raises(ValueError):
        decontaminate.walks_needed(1.1)


def test_pruned_walks_find_the_windows_of_whole_walks():
    """Few words, so that many windows share their first sampled words: the hits are those of all keys of all windows."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{min(rng.integers(300), rng.integers(300))}"
    given = [[word() for _ in range(rng.integers(8, 40))] for _ in range(60)]
    items = decontaminate.Items(list(range(60)), [" ".join(one) for one in given])
    texts = [" ".join([word() for _ in range(rng.integers(400))] + given[i % 60][: rng.integers(9, 41)]) for i in range(120)] + [""]
    words, sizes = decontaminate.word_hashes(texts)
    flat, _ = decontaminate.padded(words, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words)) + row * decontaminate.STEPS
    want = set()
    for (_, key), (_, sorted_keys, number, offset) in zip(decontaminate.keys(flat, at, items.walks), items.tables):
        entries = {}
        for k, *entry in zip(sorted_keys.tolist(), number.tolist(), offset.tolist()):
            entries.setdefault(k, []).append(entry)
        want |= {(n, a - o, r) for k, a, r in zip(key.tolist(), at.tolist(), row.tolist()) for n, o in entries.get(k, [])}
    assert set(zip(*(c.tolist() for c in items.hits(flat, at, row)))) == want and len(want) > 1000
