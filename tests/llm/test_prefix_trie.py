import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cantiere.llm import prefix_trie
from cantiere.llm.common import table
from oracle import compare, duck


def plain_nodes(rows, head=lambda c: zlib.crc32(str(c).encode()) % 4):
    """The trie by plain Python from rows (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, own in turns.items():
        h, first = head(c), c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = turns.get(first, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall("[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below[node] = (sum(below[k][0] for k in children[node]) or 1, own + sum(below[k][1] for k in children[node]))
    return sorted(((members[x][0], len(x), members[x[:-1]][0] if x else None, len(members[x]), len(children[x]), *below[x],
                    hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest()) for x in members), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_rows():
    rng, rows = random.Random(11), []
    for c in range(-45, 400):  # few texts, so that prefixes are shared at every depth; copies in between
        k = rng.randrange(6)
        rows += [(c, t, rng.choice("ab"), rng.choice(["x y", "z", "", None])) for t in range(k)]
        if c % 3 == 0:
            rows += [(c, 10 + t, "a", "the same end") for t in range(2)]
    rows += [(500, None, "a", "null turn"), (500, 0, None, None), (500, 0, "b", "tie"), (500, 0, "b", "a tie"), (500, 0, "b", "a tie"), (None, 0, "a", "nobody's"), (501, 0, "a", "é 中\x0b文 " * 5000)]
    rows += [(600 + 20 * k, t, "a", f"w{t} long") for k in range(2) for t in range(700)]  # two copies of a long one, over several ranges
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string").repartition(5)
    for name in ("depth", "a", "b", "words", "range", "shared", "last"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def test_nodes_equal_plain_trie(odd, odd_rows):
    assert got(prefix_trie.nodes(odd)) == plain_nodes(odd_rows)


@pytest.mark.parametrize("cells", [8, 1 << 9])
def test_any_size_of_the_sketch_gives_the_same(odd, odd_rows, cells):
    assert got(prefix_trie.nodes(odd, cells=cells)) == plain_nodes(odd_rows)


def test_conversations_as_they_are(odd, odd_rows):
    assert got(prefix_trie.nodes(odd, prefix_trie.no_head)) == plain_nodes(odd_rows, lambda c: 0)


def test_nodes_equal_sql(spark, sf):
    assert compare(duck(sf), prefix_trie.NODES_SQL, prefix_trie.nodes(table(spark, sf, "conversations"))) is None


def test_sketch_never_counts_less(spark, odd):
    rows = prefix_trie.prefixes(odd)
    shared = {(r.depth, r.a, r.b) for r in rows.groupBy("depth", "a", "b").count().filter("count > 1").collect()}
    for cells in (16, 1 << 14):
        said = {(r.depth, r.a, r.b) for r in prefix_trie.screened(rows, cells).filter("shared").collect()}
        assert shared <= said
    assert len(said) < 1.2 * len(shared) + 10
    bits = prefix_trie.sketch(spark.createDataFrame([(3, 7), (3, 8), (19, 9)], "a long, b long").repartition(3), 16, 8)
    assert np.unpackbits(bits).nonzero()[0].tolist() == [3]


def test_one_conversation_and_none(spark, odd):
    one = spark.createDataFrame([(7, 0, "a", "x y")], "conv_id long, turn long, role string, text string")
    assert got(prefix_trie.nodes(one)) == plain_nodes([(7, 0, "a", "x y")])
    assert prefix_trie.nodes(odd.limit(0)).count() == 0
