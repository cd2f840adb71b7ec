"""Path-flatten JSON text to (key, value) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark's JSON reader takes no text that is nested deeper, so a recursion of this many levels reaches every value.
MOST_LEVELS = 1000


def flatten_json(df: DataFrame, column: str, keep: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Rows ``keep..., key, value`` with keys such as ``a_b_0``; JSON nulls have a NULL value, empty containers no row.

    Without ``max_depth`` one recursive query reaches every depth: its plan is the same for all data, no job runs
    while it is built, and it ends with the level that has no members; Spark shuffles the members of each level. Where a bound of
    the depth is known, that many levels are written out in the plan without any shuffle; a container below them
    is one value, its JSON text. Text that is no JSON, or NULL, has no rows.
    """
    start = df.select(*keep, F.lit("").alias("key"), F.try_parse_json(F.col(column)).alias("v")).filter("v IS NOT NULL")
    found = _all_levels(start, keep) if max_depth is None else _levels(start, keep, max_depth)
    return found.select(*keep, "key", F.col("v").cast("string").alias("value"))


def _members(keep: Sequence[str]) -> str:
    child = "coalesce(e.key, CAST(e.pos AS STRING))"
    return "".join(f"t.`{c}`, " for c in keep) + f"IF(t.key = '', {child}, concat(t.key, '_', {child})) AS key, e.value AS v"


def _kind_is(*kinds: str) -> "F.Column":
    kind = F.schema_of_variant(F.col("v"))
    return F.exists(F.array(*map(F.lit, kinds)), lambda k: kind.startswith(k))


def _all_levels(start: DataFrame, keep: Sequence[str]) -> DataFrame:
    spark = start.sparkSession
    # the default ends a recursion at a million rows
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    names = ", ".join(f"`{c}`" for c in [*keep, "key", "v"])
    levels = spark.sql(
        f"WITH RECURSIVE level ({names}) MAX RECURSION LEVEL {MOST_LEVELS + 1} AS (SELECT * FROM {{start}} UNION ALL "
        f"SELECT {_members(keep)} FROM level t, LATERAL variant_explode(t.v) e) SELECT * FROM level", start=start)
    return levels.filter(~_kind_is("OBJECT<", "ARRAY<"))


def _levels(start: DataFrame, keep: Sequence[str], depth: int) -> DataFrame:
    """Each level replaces containers by their members (an empty one by a row without a value) and passes other rows on."""
    state = start
    for _ in range(depth):
        state = state.sparkSession.sql(
            f"SELECT {''.join(f't.`{c}`, ' for c in keep)}"
            "IF(t.box, concat_ws('_', nullif(t.key, ''), coalesce(e.key, CAST(e.pos AS STRING))), t.key) AS key, IF(t.box, e.value, t.v) AS v "
            "FROM {state} t, LATERAL variant_explode_outer(IF(t.box, t.v, NULL)) e", state=state.withColumn("box", _kind_is("OBJECT<", "ARRAY<"))).filter("v IS NOT NULL")
    return state.filter(~F.col("v").cast("string").isin("{}", "[]") | _kind_is("STRING") | F.col("v").cast("string").isNull())
