import random

import numpy as np

from cantiere.llm import jaccard
from llm_brute import brute_components, brute_sets


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def want(docs):
    return sorted(brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]), key=repr)


def test_sets_are_those_of_plain_python(documents):
    texts = [r.text for r in documents.collect()] + ["", "a b", "a  b\tc\nd\x0be\x0cf", "A b C d É f"]
    assert [len(s) for s in jaccard.shingle_sets(texts)] == [len(s) for s in brute_sets(texts)]
    one, two = jaccard.shingle_sets(["x", "The Cat sat on THE mat"]), jaccard.shingle_sets(["the cat sat on the mat", ""])
    assert np.array_equal(one[1], two[0]) and not len(two[1])


def test_components_of_documents(documents):
    assert got(jaccard.components(documents)) == want(documents)


def test_nulls_blanks_repeats_and_long_texts(odd_documents):
    assert got(jaccard.components(odd_documents)) == want(odd_documents)


def test_empty_table(odd_documents):
    none = odd_documents.limit(0)
    assert jaccard.components(none).count() == 0 and jaccard.keep_one(none).count() == 0


def planted(spark, heavy_group):
    """Copies with edits of few texts: links at, above and below the threshold, chains of links."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(60)]
    for base in range(6):
        text = [word() for _ in range(rng.choice([7, 30, 104, 150]))]
        if base % 2:
            text = common + text
        for _ in range(heavy_group if base == 1 else 25):
            copy = list(text)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    chain = [word() for _ in range(200)]
    for i in range(20):  # every text links with the next one only
        rows.append(" ".join(chain[6 * i:6 * i + 80]))
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)


def test_copies_with_edits_and_chains(spark, monkeypatch):
    docs = planted(spark, 150)
    expected = want(docs)
    assert got(jaccard.components(docs)) == expected
    # small blocks and salted postings give the same
    monkeypatch.setattr(jaccard, "POSTING_BLOCK", 7)
    monkeypatch.setattr(jaccard, "SALT_MEMBERS", 20)
    monkeypatch.setattr(jaccard, "HEAVY", 2)
    assert got(jaccard.components(docs)) == expected


def test_keep_one_row_per_component(documents, odd_documents):
    kept = sorted(r.doc_id for r in jaccard.keep_one(documents).collect())
    assert kept == sorted({c for _, _, c in want(documents)})
    rows = jaccard.keep_one(odd_documents)
    assert rows.columns == odd_documents.columns
    # three blank rows, one of 4/5/5, one of the two null ids, one of 7/8, both texts of id 9, one of 10/11
    assert sorted([r.doc_id for r in rows.collect()], key=str) == sorted([1, 2, 3, 4, 7, 9, 9, 10, None], key=str)
