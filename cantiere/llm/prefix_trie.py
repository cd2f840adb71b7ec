"""Trie of the common prefixes of conversations, screened by a count-min sketch.

Turns are range-partitioned by conversation and turn, so a conversation may span ranges; what lies ahead of a range comes from one
row per conversation and range. A prefix is known by two 64-bit lanes: the exclusive or of hashes of (depth, digest of
role and text), which needs no order and so is summed over ranges.

A count-min sketch counts the prefix digests. It never says less than the truth: an estimate of one proves that a single conversation
has the prefix, and its node is complete where it stands. Only prefixes that may be shared are shuffled and grouped
exactly; the size of the sketch decides how many, never what comes out.

Sums over subtrees need no walk: a node belongs to its smallest conversation, and every ancestor of the node is a prefix of that
conversation. So a leaf counts once, and tokens saved at a node count once, at each prefix of its smallest conversation.

Turns are ordered by turn, NULL first; ties by role, then the first 64 characters of the text, then the turn's digest. NULL role or
text is empty; rows without conv_id belong to no conversation and are left out; repeated rows are turns of their own; an
empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cantiere.llm.common import landed

#: Conversations of one opening group, and the most turns they take from its first conversation.
GROUP, HEAD_TURNS = 20, 3
#: Cells in each of the two rows of the sketch: four for each prefix, as a power of two, but never more than this; each
#: takes a byte in a task and a bit where it is broadcast.
MAX_CELLS = 1 << 26
#: Cells that travel together when sketches of tasks are merged.
SKETCH_BLOCK = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "a", "b"]


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEAD_TURNS + 1)).cast("int")


def no_head(conv_id: Column) -> Column:
    return F.lit(0)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, range, seq, digest, words: ``seq`` rises with (conv_id, turn, ...), the range is its upper part. No text is moved."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), F.substring(text, 1, 64).alias("opening"),
        digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("opening"), F.asc("digest")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    placed = landed(turns.sparkSession, placed.select("conv_id", "seq", F.unhex("digest").alias("digest"), "words"), "turns")
    return placed.select("conv_id", F.shiftright("seq", 33).alias("range"), "seq", "digest", "words")


def _lane(lane: int, depth: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(lane), depth.cast("long"), digest)


def prefixes(turns: DataFrame, head=head_turns, group: int = GROUP) -> DataFrame:
    """conv_id, depth, lanes a and b of the prefix, pa and pb of the one before, words of its last turn, last.

    Every conversation begins with ``head(conv_id)`` turns of the first one of its group in place of its own.
    """
    spark, rows = turns.sparkSession, numbered_turns(turns)
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per conversation and range
    stretches = rows.groupBy("conv_id", "range").agg(F.min("seq").alias("first"), F.count("*").alias("n")).select(
        "conv_id", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(whole).alias("n_own"), F.count("*").over(whole).alias("stretches"))
    stretches = landed(spark, stretches, "stretches")
    leader = F.col("conv_id") % group == 0
    first_turns = rows.filter(leader).join(stretches.filter(leader & (F.col("ahead") < HEAD_TURNS)), ["conv_id", "range"]).withColumn("pos", F.col("ahead") + F.col("seq") - F.col("first"))
    # a list of at most HEAD_TURNS turns
    heads = first_turns.filter(F.col("pos") < HEAD_TURNS).groupBy(F.col("conv_id").alias("leader")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    taken = head(F.col("conv_id"))
    convs = stretches.filter("ahead = 0").select("conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % group).alias("leader"), taken.alias("h")).join(heads, "leader", "left")
    none = F.lit(None).cast("array<struct<pos: long, digest: binary, words: long>>")
    convs = convs.withColumn("turns", F.coalesce(F.slice("turns", 1, F.col("h")), F.coalesce(none, F.array().cast("array<struct<pos: long, digest: binary, words: long>>"))))
    lanes = F.transform("turns", lambda x, i: F.struct((i + 1).alias("depth"), _lane(1, i + 1, x["digest"]).alias("la"), _lane(2, i + 1, x["digest"]).alias("lb"), x["words"].alias("words")))
    convs = convs.select("conv_id", "h", F.size("turns").alias("n_head"), (F.size("turns") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"), lanes.alias("turns"))
    upto = lambda lane, n: F.aggregate(F.slice("turns", 1, n), F.lit(0).cast("long"), lambda done, x: done.bitwiseXOR(x[lane]))
    convs = landed(spark, convs.withColumn("ha", upto("la", F.col("n_head"))).withColumn("hb", upto("lb", F.col("n_head"))), "conversations")

    places = stretches.join(convs.drop("turns"), "conv_id").select("conv_id", "range", "first", "ahead", "stretches", "h", "n_head", "length", "ha", "hb")
    pos = F.col("ahead") + F.col("seq") - F.col("first")
    own = rows.join(places, ["conv_id", "range"]).filter(pos >= F.col("h")).withColumn("depth", F.col("n_head") + pos - F.col("h") + 1)
    own = own.withColumn("la", _lane(1, F.col("depth"), F.col("digest"))).withColumn("lb", _lane(2, F.col("depth"), F.col("digest")))
    inside = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = own.select("conv_id", "range", "depth", "length", "words", "stretches", "la", "lb",
                     F.bit_xor("la").over(inside).bitwiseXOR(F.col("ha")).alias("a"), F.bit_xor("lb").over(inside).bitwiseXOR(F.col("hb")).alias("b"))
    own = landed(spark, own, "own-turns")
    # conversations in several ranges: at most two rows a range
    sums = own.filter("stretches > 1").groupBy("conv_id", "range").agg(F.bit_xor("la").alias("sa"), F.bit_xor("lb").alias("sb"))
    sums = sums.select("conv_id", "range", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("sa", "sb")))
    own = own.join(F.broadcast(sums), ["conv_id", "range"], "left")
    own = own.select("conv_id", "depth", "length", "words", "la", "lb", *(F.col(x).bitwiseXOR(F.coalesce(F.col(f"s{x}"), F.lit(0))).alias(x) for x in ("a", "b")))
    lent = convs.select("conv_id", "length", "turns", F.explode("turns").alias("x")).select(
        "conv_id", F.col("x.depth").cast("long").alias("depth"), "length", "x.words", "x.la", "x.lb", upto("la", F.col("x.depth")).alias("a"), upto("lb", F.col("x.depth")).alias("b"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "length", zero.alias("words"), zero.alias("la"), zero.alias("lb"), zero.alias("a"), zero.alias("b"))
    every = own.unionByName(lent).unionByName(roots)
    return every.select("conv_id", *NODE, F.col("a").bitwiseXOR(F.col("la")).alias("pa"), F.col("b").bitwiseXOR(F.col("lb")).alias("pb"), "words", (F.col("depth") == F.col("length")).alias("last"))


def _merge(into: tuple[np.ndarray, np.ndarray], once: np.ndarray, twice: np.ndarray) -> None:
    """Counters of 0, 1 and "2 or more" as two bits: add another task's."""
    into[1][:] |= twice | (into[0] & once)
    into[0][:] |= once


def sketch(rows: DataFrame, cells: int, block: int = SKETCH_BLOCK) -> np.ndarray:
    """Bits of a count-min sketch of two rows: is the counter of a cell two or more? 2 * cells / 8 bytes."""
    block = min(block, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for batch in batches:
            if counters is None:
                counters = np.zeros((2, cells), np.uint8)
            for k, lane in enumerate(("a", "b")):
                cell, n = np.unique(batch[lane].to_numpy() & (cells - 1), return_counts=True)
                counters[k, cell] = np.minimum(counters[k, cell] + n, 2)
        if counters is None:
            return
        for k in range(2):
            for at in range(0, cells, block):
                part = counters[k, at:at + block]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"at": pa.array([k * cells + at], pa.int64()), "once": pa.array([np.packbits(part > 0).tobytes()], pa.binary()),
                                                      "twice": pa.array([np.packbits(part > 1).tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, None
        for batch in batches:
            for place, once, twice in zip(*(batch[c].to_pylist() for c in ("at", "once", "twice"))):
                if place != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"at": [at], "twice": [bits[1].tobytes()]})
                    at, bits = place, (np.zeros(block // 8, np.uint8), np.zeros(block // 8, np.uint8))
                _merge(bits, np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8))
        if at is not None:
            yield pa.RecordBatch.from_pydict({"at": [at], "twice": [bits[1].tobytes()]})

    parts = rows.select("a", "b").mapInArrow(count, "at long, once binary, twice binary")
    merged = parts.repartition("at").sortWithinPartitions("at").mapInArrow(merge, "at long, twice binary")
    out = np.zeros(2 * cells // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most MAX_CELLS / 4 bytes in all
        out[row["at"] // 8:(row["at"] + block) // 8] = np.frombuffer(row["twice"], np.uint8)
    return out


def screened(rows: DataFrame, cells: int | None = None) -> DataFrame:
    """The prefixes with ``shared`` and ``parent_shared``: false where one conversation is proven to be the only one."""
    spark = rows.sparkSession
    if cells is None:
        cells = min(MAX_CELLS, 1 << max(12, int(4 * rows.count()).bit_length()))
    bits = spark.sparkContext.broadcast(sketch(rows, cells))

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for k, lane in enumerate((a, b)):
            cell = k * cells + (lane.to_numpy(np.int64) & (cells - 1))
            out &= (bits.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(out)

    return landed(spark, rows.withColumn("shared", maybe("a", "b")).withColumn("parent_shared", maybe("pa", "pb")), "screened")


def ends_digest(ends: DataFrame) -> DataFrame:
    """sha256 of the rising, comma-joined conv_ids of each node (depth, a, b).

    A node's ids are sorted over ranges and joined to texts of one batch each; one task then reads these
    texts in order, one at a time.
    """
    schema = "depth long, a long, b long, first long, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = [batch[c].to_numpy() for c in NODE], batch["conv_id"].to_pylist()
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), len(ids)]
            yield pa.RecordBatch.from_pydict({**{c: k[cuts[:-1]] for c, k in zip(NODE, keys)}, "first": [ids[i] for i in cuts[:-1]],
                                              "ids": [",".join(map(str, ids[i:j])) for i, j in zip(cuts, cuts[1:])]})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, text in zip(*(batch[c].to_pylist() for c in (*NODE, "ids"))):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends"), map(list, zip(*done)))))
        if node is not None:
            yield pa.RecordBatch.from_pydict({**{c: [k] for c, k in zip(NODE, node)}, "ends": [state.hexdigest()]})

    order = [*NODE, "conv_id"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, schema)
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, a long, b long, ends string")


def nodes(turns: DataFrame, head=head_turns, group: int = GROUP, cells: int | None = None) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    rows = screened(prefixes(turns, head, group), cells)
    maybe, sure = rows.filter("shared"), rows.filter("NOT shared")
    exact = maybe.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
        F.max(F.col("parent_shared") & (F.col("depth") > 0)).alias("parent_shared"))
    exact = landed(spark, exact, "nodes")
    tops = sure.filter("parent_shared AND depth > 0")  # where the tail of one conversation leaves the shared part

    links = [F.col("depth") - 1, F.col("pa"), F.col("pb")]
    links = [c.alias(n) for c, n in zip(links, NODE)]
    children = exact.filter("parent_shared").select(*links).unionByName(tops.select(*links)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    owned = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    counted = exact.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = landed(spark, counted.withColumn("below", F.sum((F.col("n_convs") - 1) * F.col("words")).over(owned)), "counted")

    # what a conversation adds to its prefixes: a leaf, and the tokens saved at the nodes it is the smallest of
    leaves = sure.filter("last").select("conv_id").unionByName(counted.filter("n_children = 0").select("conv_id"))
    zero = F.lit(0).cast("long")
    adds = leaves.select("conv_id", F.lit(1).cast("long").alias("leaf"), zero.alias("saved"), zero.alias("top")).unionByName(
        counted.groupBy("conv_id").agg(zero.alias("leaf"), F.max("below").alias("saved"), F.min("depth").alias("top")))
    adds = adds.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.max("top").alias("top")).filter("leaf > 0 OR saved > 0")
    sums = maybe.select("conv_id", *NODE).join(adds, "conv_id").groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("depth") < F.col("top"), F.col("saved")).otherwise(0)).alias("from_others"))
    whole = counted.join(sums, NODE, "left").join(ends_digest(maybe.filter("last")), NODE, "left").select(
        "conv_id", "depth", "pa", "pb", "parent_shared", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"),
        (F.col("below") + F.coalesce("from_others", zero)).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))

    one = F.lit(1).cast("long")
    tails = sure.select("conv_id", "depth", "pa", "pb", "parent_shared", one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
                        zero.alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    asks = F.col("parent_shared") & (F.col("depth") > 0)
    parents = exact.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    found = whole.filter(asks).unionByName(tails.filter(asks)).join(parents, ["depth", "pa", "pb"])
    known = whole.filter(~asks).unionByName(tails.filter(~asks)).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return found.select(*out).unionByName(known.select(*out))


#: crc32 by bits: each byte of the decimal id, eight shifts each.
NODES_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, i: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
prefix AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), ',') OVER w AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY conv_id) AS length
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL
  SELECT c.conv_id, 0, '', 0, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM crc c),
node AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth) AS ends
  FROM prefix GROUP BY depth, path),
child AS (
  SELECT n.depth, n.path, p.depth AS parent_depth, p.path AS parent_path
  FROM node n JOIN prefix p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
below AS (
  SELECT p.depth, p.path, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE NOT EXISTS (
           SELECT 1 FROM child c WHERE c.parent_depth = n.depth AND c.parent_path = n.path)) AS n_leaves
  FROM node n JOIN prefix p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.path)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs,
       (SELECT count(*) FROM child c WHERE c.parent_depth = n.depth AND c.parent_path = n.path) AS n_children,
       b.n_leaves, b.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n JOIN below b USING (depth, path)
LEFT JOIN child k ON k.depth = n.depth AND k.path = n.path
LEFT JOIN node u ON u.depth = k.parent_depth AND u.path = k.parent_path
"""
