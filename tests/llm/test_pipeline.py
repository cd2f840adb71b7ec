import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from cantiere.llm import quality
from cantiere.llm.common import table
from llm_brute import brute_components
from test_decontaminate import brute_distance, words_of


def test_run_equals_plain_stages(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    forest = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    good = [i for i, kept in zip(docs, quality.verdicts([r.text or "" for r in docs.values()], forest)["kept"]) if kept]
    one = [i for i, _, component in brute_components([(i, docs[i].text) for i in good]) if i == component]
    items = [words_of(r.text) for r in table(spark, sf, "benchmark").collect()]

    def holds_item(text):
        words = words_of(text)
        return any(len(set(words) & set(item)) >= 0.5 * len(set(item)) and brute_distance(item, words) <= 0.2 * len(item) for item in items)

    clean = [i for i in one if not holds_item(docs[i].text)]
    assert len(docs) > len(good) > len(one) > len(clean)
    clean_rows = table(spark, sf, "documents").filter(f"doc_id IN ({', '.join(map(str, clean))})")
    texts = {r.doc_id: r.text for r in corpus_pipeline.safe_documents(spark, clean_rows, sf).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in texts.items():
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        want[i] = (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf, odd_documents):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_documents, sf)
        assert out.schema.simpleString() == odd_documents.schema.simpleString(), name
        assert stage(spark, odd_documents.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd_documents, sf).count() == odd_documents.count()


def test_registered():
    names = entry.queries()
    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} <= {n.split("_")[0] for n in names}
    assert set(entry.oracle_sql()) <= set(names)
