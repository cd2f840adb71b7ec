"""Interned sets: every distinct set of items is stored once, keys carry its id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantiere.operators.dedupe import top_per_key
from cantiere.operators.scale import lists_per_key

#: Items of a set that stand in one row.
SET_LIMIT = 1_000


def _lanes() -> dict[str, Column]:
    """Two 64-bit hashes of ``item``."""
    text = F.to_json(F.struct("item"))
    return {f"_lane{lane}": F.xxhash64(F.lit(lane), text) for lane in (1, 2)}


def _digest(count: Column, *lanes: Column) -> Column:
    """Lanes and count as a short text: exchanges carry it in every row, and it does not compress."""
    code = F.base64(F.unhex(F.concat(*[F.lpad(F.hex(lane), 16, "0") for lane in lanes])))
    return F.concat_ws("-", F.rtrim(code, F.lit("=")), count.cast("string"))


def intern(df: DataFrame, keys: Sequence[str], item: Column) -> tuple[DataFrame, DataFrame]:
    """Sets of items per key as ``(keys, set_id, n_items)``, and their members once per set as ``(set_id, item)``.

    The id is an order-free digest of the distinct items: two exclusive ors of 64-bit hashes and the count, 128 bits and
    more.  A set is never in one cell: items are rows, a hot key's are spread by item, and of keys with the same set only the
    smallest lends its rows.  Rows with a NULL key or item belong to no set; a key without items has none.
    """
    keys = list(keys)
    # said outright, so that no reader of ``once`` adds a condition of its own and all read one exchange
    held = [F.col(c).isNotNull() for c in (*keys, "item")]
    once = df.select(*keys, item.alias("item")).filter(reduce(and_, held)).distinct()
    digest = _digest(F.count(F.lit(1)), *[F.bit_xor(lane) for lane in _lanes().values()])
    ids = once.groupBy(*keys).agg(digest.alias("set_id"), F.count(F.lit(1)).alias("n_items"))
    lender = ids.groupBy("set_id").agg(F.min(F.struct(*keys)).alias("_first")).select("set_id", "_first.*")
    return ids, once.join(lender, keys).select("set_id", "item")


def tag(df: DataFrame, keys: Sequence[str], item: Column, position: Sequence[Column]) -> DataFrame:
    """The first row of every key and distinct ``item``, with ``set_id`` and ``n_items`` of the key's set (as in :func:`intern`)
    and its place among them (``_rank``, 1 is the first row of the key).

    All three are windows of one key: rows that already lie together by some of the keys are not sent again. The items of
    a set are its rows (:func:`members_of`), never a cell.  Keys must not be NULL; a NULL item belongs to no set.
    """
    each = top_per_key(df.withColumn("item", item), [*keys, "item"], position)
    each = each.withColumns({name: F.when(F.col("item").isNotNull(), lane) for name, lane in _lanes().items()})
    of_key = Window.partitionBy(*keys)
    ranked = each.withColumns({
        "n_items": F.count("item").over(of_key), **{name: F.bit_xor(name).over(of_key) for name in _lanes()},
        "_rank": F.row_number().over(of_key.orderBy(*position)),
    })
    digest = _digest(F.col("n_items"), *map(F.col, _lanes()))
    return ranked.withColumn("set_id", F.when(F.col("n_items") > 0, digest)).drop(*_lanes())


def members_of(tagged: DataFrame) -> DataFrame:
    """Members of each distinct set, once, as ``(set_id, item)``."""
    return tagged.filter(F.col("item").isNotNull()).select("set_id", "item").distinct()


def lists(members: DataFrame, items: str = "items", limit: int = SET_LIMIT) -> DataFrame:
    """``set_id, part, <items>, n_items``: sorted items in parts of bounded size, the total in each."""
    return lists_per_key(members, ["set_id"], F.col("item"), items, limit)
