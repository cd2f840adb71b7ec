"""Chat formatting by perspective rotation. DataFrame functions only.

Every speaker of a conversation gets the dialogue once with their own turns as ``assistant``, all others as named
users, and the mask of what that assistant says. ``system`` turns are shown to everyone and are nobody's view; a
conversation without any other speaker is rendered once with a NULL participant and an empty mask.

A dialogue is cut into parts of PART_TURNS turn numbers, by one rule for every length, so that no row holds an
unbounded conversation and a hot one is spread over tasks. The mask holds the code point ranges ``start-end`` of
the assistant's texts with their end marks, in the rendered part.

Rows of a part are ordered by turn, role, text; turns with a NULL number form a part of their own with NULL part.
Rows equal in conversation, turn, role and text are one message (``n_rows`` counts them all). A NULL role speaks as
user ``unknown`` and has no view; NULL texts are empty. NULL conv_id is a conversation. The marks' opening ``<|`` inside texts is
broken up. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PART_TURNS = 64

_NAME = "regexp_replace(coalesce({0}, 'unknown'), '[^A-Za-z0-9_.-]', '_')"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, part, participant, n_messages, n_rows, rendered, mask, n_masked (code points in the mask)."""
    once = (turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
            .groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")))
    speakers = once.filter("role IS NOT NULL AND role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    message = F.expr("struct(turn, coalesce(role, '') AS by_role, coalesce(replace(text, '<|', '< |'), '') AS text, role, n)")
    parts = (once.withColumn("part", F.floor(F.col("turn") / PART_TURNS)).groupBy("conv_id", "part")
             .agg(F.array_sort(F.collect_list(message)).alias("messages"), F.sum("n").alias("n_rows")))
    # one array of speakers to each part, a part being up to PART_TURNS messages
    both = parts.join(speakers.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    views = both.withColumn("participant", F.explode_outer("speakers"))
    head = (f"CASE WHEN m.role = participant THEN '<|assistant|>\n' WHEN m.role = 'system' THEN '<|system|>\n' "
            f"ELSE concat('<|user name=', {_NAME.format('m.role')}, '|>\n') END")
    pieces = views.withColumn("pieces", F.expr(
        f"transform(messages, m -> struct({head} AS head, concat(m.text, '<|end|>') AS body, coalesce(m.role = participant, false) AS own))"))
    at = "aggregate(slice(pieces, 1, i), 0L, (n, p) -> n + length(p.head) + length(p.body) + 1)"
    spans = (f"filter(transform(pieces, (p, i) -> IF(p.own, concat({at} + length(p.head), '-', {at} + length(p.head) + length(p.body)), '')), s -> s <> '')")
    return pieces.select(
        "conv_id", "part", "participant", F.size("messages").cast("long").alias("n_messages"), F.col("n_rows").cast("long").alias("n_rows"),
        F.expr("array_join(transform(pieces, p -> concat(p.head, p.body, '\n')), '')").alias("rendered"),
        F.expr(f"array_join({spans}, ',')").alias("mask"),
        F.expr("aggregate(pieces, 0L, (n, p) -> n + IF(p.own, length(p.body), 0))").alias("n_masked"))


#: The same by DuckDB.
ROTATE_SQL = f"""
WITH once AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, count(*) AS n FROM conversations GROUP BY ALL),
m AS (SELECT *, CAST(floor(turn / {PART_TURNS}) AS BIGINT) AS part, coalesce(role, '') AS by_role, coalesce(replace(text, '<|', '< |'), '') AS shown FROM once),
s AS (SELECT DISTINCT conv_id, role AS participant FROM m WHERE role IS NOT NULL AND role <> 'system'),
v AS (SELECT m.*, s.participant FROM m LEFT JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, CASE WHEN role = participant THEN '<|assistant|>\n' WHEN role = 'system' THEN '<|system|>\n'
      ELSE concat('<|user name=', regexp_replace(coalesce(role, 'unknown'), '[^A-Za-z0-9_.-]', '_', 'g'), '|>\n') END AS head,
      concat(shown, '<|end|>') AS body, coalesce(role = participant, false) AS own FROM v),
w AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, participant ORDER BY turn, by_role, shown, role NULLS FIRST, n
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM p)
SELECT conv_id, part, participant, count(*) AS n_messages, CAST(sum(n) AS BIGINT) AS n_rows,
       string_agg(concat(head, body, '\n'), '' ORDER BY turn, by_role, shown, role NULLS FIRST, n) AS rendered,
       coalesce(string_agg(concat(CAST(start AS BIGINT), '-', CAST(start + length(body) AS BIGINT)), ',' ORDER BY start) FILTER (own), '') AS mask,
       CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_masked
FROM w GROUP BY conv_id, part, participant
"""
