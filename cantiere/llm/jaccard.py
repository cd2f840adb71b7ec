"""Similarity join on 5-word shingles with adaptive multi-match prefixes.

Shingles are 64-bit hashes of five lower-cased words. All shingles have one global order: rare ones first (by hash), then
the heavy ones by document frequency. Two sets of n and m shingles that link share at least
ceil(4 (n + m) / 9) of them, so the first n - ceil(0.8 n) + l of one and the same of the other share at least
l. Every document picks the l between 1 and MOST_MATCHES with the least estimated cost of its prefix (postings read, plus
verifications): documents made of frequent passages take longer prefixes and must share more of them. A
pair is a candidate when its prefixes share min(l, l') shingles at which the position bound
min(l, l') + min(n - i, m - j) >= ceil(4 (n + m) / 9) holds, which is true of the first min(l, l') shared ones of every
linked pair. Candidates are verified on the full sets. The order changes cost only, never the result.

Equal sets are one class from the start. Members of a posting are first compared with its most central
member, and only members that are still in different components are paired afterwards: no group emits all
its pairs. Links between classes that are already connected are not counted one by one.

NULL or blank texts have an empty set and are alone. Repeated rows and ids stay rows of one class. A
component is named by its smallest non-NULL id (NULL if all are NULL). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

from cantiere.llm.common import blocks, landed, mix64, split_sizes

WINDOW = 5
#: Largest number of shared prefix shingles asked for.
MOST_MATCHES = 4
#: A shingle of at least so many documents is ordered by its frequency, as long as it is among the HEAVIEST.
HEAVY, HEAVIEST = 8, 1 << 20
#: Shingles per range when frequencies are counted.
RANGE_SHINGLES = 2_000_000
#: Shingles that a task gathers before it sorts and sends them.
SENT_SHINGLES = 500_000
#: Members of a posting that one group compares with each other.
POSTING_BLOCK = 4096
#: Members of one salted part of a posting.
SALT_MEMBERS = 50_000
#: Bits of the filter that keeps the sets of documents without candidates out of the shuffle.
FILTER_BITS = 1 << 26

_RNG = np.random.default_rng(20240501)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODES[65:91] = _BYTE_CODES[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_STEPS = _RNG.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, sorted."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))  # word starts and ends in turn
    starts, ends = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    words = mix64((total[ends] - total[starts]) * _powers(_BASE_INVERSE, len(data))[starts])
    text_ends = np.cumsum(split_sizes(raw) + 1)
    last = np.searchsorted(starts, text_ends)
    grams = mix64(reduce(np.add, (words[i:len(words) - WINDOW + 1 + i] * _STEPS[i] for i in range(WINDOW)))) if len(words) >= WINDOW else None
    out, first = [], 0
    for end in last.tolist():
        n = end - first
        if n >= WINDOW:
            out.append(np.unique(grams[first:end - WINDOW + 1]))
        elif n:
            out.append(mix64((words[first:end] * _STEPS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        first = end
    return out


def set_code(grams: np.ndarray) -> int | None:
    """64-bit code of a set, NULL for the empty one."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(grams.tobytes()), ">i8")[0]) if len(grams) else None


def set_codes(texts: pd.Series) -> list[int | None]:
    return [set_code(s) for s in shingle_sets(texts.tolist())]


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cid (code of the set)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text"):
            sets = shingle_sets(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": split_sizes(sets),
                                "cid": pd.array([set_code(s) for s in sets], "Int64")})

    return _texts(docs).mapInPandas(run, "doc_id long, n_shingles long, cid long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def heavy_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Key (leading bits) and document frequency of the heaviest shingles, and the number of bits dropped from a hash.

    Exact counts of 32-bit keys in ranges whose number follows the data; hashes travel packed.
    """
    bits = max(6, math.ceil(math.log2(max(1, total / RANGE_SHINGLES))))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0
        for pdf in blocks(batches, "text"):
            sets = shingle_sets(pdf["text"].tolist())
            waiting.extend(sets)
            size += int(split_sizes(sets).sum())
            if size >= SENT_SHINGLES:
                yield flush(waiting)
                waiting, size = [], 0
        if size:
            yield flush(waiting)

    def flush(sets: list[np.ndarray]) -> pd.DataFrame:
        grams = np.sort(np.concatenate(sets))
        cuts = np.searchsorted(grams, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        keys = ((grams << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        # differences by byte plane: the leading planes are nearly constant and compress
        packs = [np.diff(k, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for k in np.split(keys, cuts)]
        out = pd.DataFrame({"part": np.arange(1 << bits, dtype=np.int32), "keys": packs})
        return out[out["keys"].str.len() > 0]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        packs = [np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().cumsum(dtype=np.uint32) for b in pdf["keys"]]
        keys, df = np.unique(np.concatenate(packs), return_counts=True)
        keys, df = keys[df >= HEAVY], df[df >= HEAVY]
        return pd.DataFrame({"key": (np.int64(pdf["part"].iloc[0]) << 32) + keys.astype(np.int64), "df": df})

    counted = _texts(docs).mapInPandas(packed, "part int, keys binary").groupBy("part").applyInPandas(count, "key long, df long")
    # bounded by HEAVIEST rows of 16 bytes
    top = counted.orderBy(F.desc("df"), "key").limit(HEAVIEST).toPandas().sort_values("key")
    return top["key"].to_numpy(np.uint64), top["df"].to_numpy(np.int64), 64 - bits - 32


class Order:
    """The global order of shingles and the prefix of a set."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, dropped: int):
        self.keys, self.df, self.dropped = keys, df, np.uint64(dropped)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def frequencies(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), np.int64)
        key = grams >> self.dropped
        some = np.flatnonzero(self.maybe[(key & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
            hit = self.keys[at] == key[some]
            out[some[hit]] = self.df[at[hit]]
        return out

    def prefix(self, grams: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Shingles of the chosen prefix in order, their frequencies, and the matches it asks for."""
        n = len(grams)
        shortest = n - -(-4 * n // 5) + 1
        most = min(MOST_MATCHES, n - shortest + 1)
        reach = shortest + most - 1
        heavy = df > 1
        n_rare = n - int(np.count_nonzero(heavy))
        if n_rare >= reach:  # only rare shingles: one match is cheapest
            return grams[~heavy][:shortest], np.ones(shortest, np.int64), 1
        late = np.flatnonzero(heavy)
        late = late[np.lexsort((grams[late], df[late]))]
        order = np.concatenate([np.flatnonzero(~heavy), late])[:reach]
        read = np.cumsum(df[order])
        matches = np.arange(1, most + 1)
        scanned = read[shortest + matches - 2]
        candidates = (scanned - (shortest + matches - 1)) / matches  # a candidate takes that many postings
        chosen = int(np.argmin(scanned + candidates * (n / 16))) + 1
        order = order[:shortest + chosen - 1]
        return grams[order], df[order], chosen


POSTING = "token long, salt int, cid long, n int, pos int, l int"


def postings(docs: DataFrame, order: Order) -> DataFrame:
    """Prefix entries of every distinct set, without tokens that only one set has."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in blocks(batches, "text"):
            sets = {c: s for s in shingle_sets(pdf["text"].tolist()) if (c := set_code(s)) is not None and c not in seen}
            seen.update(sets)
            if not sets:
                continue
            sizes = split_sizes(list(sets.values()))
            df = np.split(order.frequencies(np.concatenate(list(sets.values()))), np.cumsum(sizes)[:-1])
            found = [order.prefix(grams, f) for grams, f in zip(sets.values(), df)]
            lengths = split_sizes([f[0] for f in found])
            cid = np.repeat(np.fromiter(sets, np.int64, len(sets)), lengths)
            parts = -(-np.concatenate([f[1] for f in found]) // SALT_MEMBERS)
            yield pd.DataFrame({
                "token": np.concatenate([f[0] for f in found]).view(np.int64),
                "salt": np.where(parts > 1, 1 + np.mod(cid >> 7, parts), 0).astype(np.int32),
                "cid": cid, "n": np.repeat(sizes, lengths).astype(np.int32),
                "pos": np.concatenate([np.arange(1, k + 1, dtype=np.int32) for k in lengths]),
                "l": np.repeat(np.array([f[2] for f in found], np.int32), lengths),
            })

    whole = Window.partitionBy("token", "salt")
    return (_texts(docs).mapInPandas(run, POSTING).repartition("token", "salt").dropDuplicates(["token", "salt", "cid"])
            .withColumn("low", F.min("cid").over(whole)).withColumn("high", F.max("cid").over(whole))
            .withColumn("hub", F.min(F.struct("pos", "cid", "n", "l")).over(whole))
            .filter("low <> high OR salt > 0").drop("low", "high"))


def _hub_pairs(entries: DataFrame) -> DataFrame:
    """Distinct pairs of a posting's members with its most central member, and of the hubs of salted parts."""
    bound = ("cid <> hub.cid AND 5 * least(n, hub.n) >= 4 * greatest(n, hub.n) "
             "AND 9 * (least(l, hub.l) + least(n - pos, hub.n - hub.pos)) >= 4 * (n + hub.n)")
    pair = [F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")]
    members = entries.filter(bound).select(*pair)
    hubs = entries.filter("salt > 0").select("token", F.col("hub").alias("part_hub")).distinct()
    tops = hubs.groupBy("token").agg(F.min("part_hub").alias("hub"))
    between = hubs.join(tops, "token").select("part_hub.*", "hub").filter(bound).select(*pair)
    return members.union(between).distinct()


def _cross_pairs(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates among members of a posting that are in different components."""
    own = entries.select("token", "cid", "n", "pos", "l").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    tokens = (own.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"))
              .filter("low <> high").select("token", F.ceil(F.col("m") / POSTING_BLOCK).alias("n_blocks")))
    spread = (own.join(tokens, "token").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n_blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
              .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    keys = ["token", "low", "high"]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            final = pdf[keys].iloc[-1]
            open_from = int(np.flatnonzero((pdf[keys] != final).any(axis=1).to_numpy())[-1]) + 1 if (pdf[keys] != final).any(axis=None) else 0
            rest = pdf.iloc[open_from:]
            yield from _pairs_of_groups(pdf.iloc[:open_from], keys)
        if rest is not None:
            yield from _pairs_of_groups(rest, keys)

    found = spread.select(*keys, "block", "cid", "n", "pos", "l", "label").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(pairs, "a long, b long, l int")
    return found.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("l").alias("l")).filter("shared >= l").select("a", "b")


def _pairs_of_groups(pdf: pd.DataFrame, keys: list[str]) -> Iterator[pd.DataFrame]:
    if len(pdf) < 2:
        return
    c = {k: pdf[k].to_numpy(np.int64) for k in pdf.columns}
    size = len(pdf)
    new = np.ones(size, bool)
    new[1:] = np.any([c[k][1:] != c[k][:-1] for k in keys], axis=0)
    group = np.cumsum(new)
    for step in range(1, int(np.bincount(group).max())):
        x = np.flatnonzero(group[:-step] == group[step:])
        y = x + step
        l = np.minimum(c["l"][x], c["l"][y])
        n, m = c["n"][x], c["n"][y]
        good = (c["label"][x] != c["label"][y]) & ((c["low"][x] == c["high"][x]) | (c["block"][x] != c["block"][y]))
        good &= 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
        good &= 9 * (l + np.minimum(n - c["pos"][x], m - c["pos"][y])) >= 4 * (n + m)
        x, y, l = x[good], y[good], l[good]
        if len(x):
            yield pd.DataFrame({"a": np.minimum(c["cid"][x], c["cid"][y]), "b": np.maximum(c["cid"][x], c["cid"][y]), "l": l.astype(np.int32)})


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    slot = F.col("cid").bitwiseAND(F.lit(FILTER_BITS - 1))
    # bounded by FILTER_BITS bits; a full filter passes more sets, the join below decides
    words = (wanted.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, CAST((cid & {FILTER_BITS - 1}) & 63 AS INT))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    present = bits.view(np.uint8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in blocks(batches, "text"):
            rows = {}
            for grams in shingle_sets(pdf["text"].tolist()):
                code = set_code(grams)
                if code is not None and code not in seen:
                    at = code & (FILTER_BITS - 1)
                    if present[at >> 3] >> (at & 7) & 1:
                        rows[code] = grams.tobytes()
            seen.update(rows)
            yield pd.DataFrame({"cid": np.fromiter(rows, np.int64, len(rows)), "grams": list(rows.values())})

    sets = _texts(docs).mapInPandas(run, "cid long, grams binary").dropDuplicates(["cid"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    both = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInPandas(decide, "a long, b long")


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return 9 * int(np.count_nonzero(y[at] == x)) >= 4 * (len(x) + len(y))


def connect(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """cid, label (smallest reachable cid) of every end of an edge: least labels of neighbours with pointer jumps."""
    both = landed(spark, edges.select(F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("b").alias("near")),
                                                        F.struct(F.col("b").alias("cid"), F.col("a").alias("near")))).alias("e")).select("e.*").distinct(), "links")
    labels = landed(spark, both.groupBy("cid").agg(F.least(F.min("cid"), F.min("near")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cid", "near"), "near").groupBy("cid").agg(F.min("label").alias("best"))
        nearer = labels.join(near, "cid").select("cid", F.least("label", "best").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("cid").alias("label"), F.col("label").alias("further"))
        step = nearer.join(jump, "label", "left").select("cid", F.least("label", "further").alias("label"), "was")
        step = landed(spark, step, "labels")
        labels = step.select("cid", "label")
        if not step.filter("label <> was").limit(1).count():
            return labels


def class_labels(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """cid, label of every set that links with another one; ``rows`` are the landed profiles."""
    spark = docs.sparkSession
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    order = Order(*heavy_shingles(docs, total))
    entries = landed(spark, postings(docs, order), "postings")
    near = landed(spark, verified(docs, landed(spark, _hub_pairs(entries), "pairs")), "near")
    labels = connect(spark, near)
    across = landed(spark, _cross_pairs(entries, labels), "pairs")
    if not across.limit(1).count():
        return labels
    more = verified(docs, across)
    # the new links join whole components
    known = labels.select(F.col("cid").alias("a"), F.col("label").alias("b")).filter("a <> b")
    return connect(spark, known.union(more))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The landed profiles, and (cid, component_id, label) of every set."""
    spark = docs.sparkSession
    rows = landed(spark, profiles(docs), "profiles")
    classes = rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first_id"))
    named = landed(spark, classes.join(class_labels(docs, rows), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "classes")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return rows, named.join(least, "label")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, classes = _components(docs)
    return rows.join(classes.select("cid", "component_id"), "cid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of its smallest id. Rows without words stay.

    Among rows of the same id and set the one with the smallest hash of all its columns stays.
    """
    columns = docs.columns
    _, classes = _components(docs.select("doc_id", "text"))
    # one set per component: the one with the smallest id, then the smallest code
    chosen = classes.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "cid"))["cid"].alias("cid"))

    @pandas_udf("long")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [pd.Series(pd.array(set_codes(p["text"]), "Int64")) for p in blocks([texts.to_frame("text")], "text")]
            yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="Int64")

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), code(docs["text"]).alias("cid"))
    blank = whole.filter("cid IS NULL")
    first = Window.partitionBy("cid").orderBy(F.col("row.doc_id").asc_nulls_last(), F.xxhash64("row"))
    ranked = whole.filter("cid IS NOT NULL").withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    kept = ranked.join(chosen, "cid", "left_semi")
    return kept.select("row").union(blank.select("row")).select("row.*")


#: :func:`components` of ``documents`` by DuckDB, all pairs of sets that share a shingle counted.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
     'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)])
     WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams FROM w),
d AS (SELECT doc_id, grams, len(grams) AS n, md5(array_to_string(list_sort(grams), chr(10))) AS code FROM s),
c AS (SELECT code, min(doc_id) AS id, any_value(n) AS n, any_value(grams) AS grams FROM d WHERE n > 0 GROUP BY code),
g AS (SELECT id, n, unnest(grams) AS gram FROM c),
e AS (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
     GROUP BY x.id, y.id HAVING 9 * count(*) >= 4 * (any_value(x.n) + any_value(y.n))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reached(id, far) AS (SELECT id, id FROM c UNION SELECT r.id, l.b FROM reached r JOIN both_ways l ON l.a = r.far),
least_id AS (SELECT id, min(far) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN c ON c.code = d.code AND d.n > 0 LEFT JOIN least_id l ON l.id = c.id
"""
