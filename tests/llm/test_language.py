import zlib

import numpy as np
from pyspark.sql import functions as F

from cantiere.llm import language
from cantiere.llm.common import id_bucket, table


def plain_grams(text):
    """Grams by plain Python: words with an edge on both sides."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return sorted(f" {w} "[i:i + n] for w in words for n in language.ORDERS for i in range(len(w) + 3 - n))


def test_grams_equal_plain_python(documents, odd_documents):
    texts = [r.text or "" for df in (documents, odd_documents) for r in df.select("text").limit(60).collect()] + ["", "a", "É b1c", "don't"]
    found = {i: [] for i in range(len(texts))}
    seen = {}
    for codes, text in language.grams(texts):
        for code, i in zip(codes.tolist(), text.tolist()):
            found[i].append(code)
    for i, text in enumerate(texts):
        plain = plain_grams(text)
        assert len(found[i]) == len(plain)
        for gram in set(plain):
            seen.setdefault(gram, set())
    codes = {c for one in found.values() for c in one}
    assert len(codes) == len(seen)


def test_filters_contain_every_gram_of_a_language_alone(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (2, "gamma delta", "y")], "doc_id long, text string, lang string")
    filters = language.learn(docs, id_bucket("doc_id", 1) == 0)
    assert sorted(filters.languages) == ["x", "y"]
    names, score = filters.predict(["alpha", "delta gamma", "", "12 ?!", "zzz"])
    assert names[:2] == ["x", "y"] and names[2:4] == ["und", "und"] and score[0] > 0.9 and not score[2:].any()


def test_more_languages_than_a_table_holds(spark):
    rows = [(i, " ".join(chr(97 + i) * k for k in range(2, 7)), f"l{i:02}") for i in range(20)]
    filters = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), id_bucket("doc_id", 1) == 0)
    assert len(filters.tables) == 3 and filters.predict([t for _, t, _ in rows])[0] == [lang for *_, lang in rows]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows_and_empty_tables(odd_documents):
    rows = language.identify(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert language.identify(odd_documents.limit(0)).count() == 0
    unlearnt = language.identify(odd_documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlearnt.collect()} == {"und"}
