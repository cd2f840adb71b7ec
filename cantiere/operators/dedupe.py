"""One row per key.

All choices use a ranked filter.  Spark turns it into a group limit that runs before the
shuffle, so a key with very many rows sends only its best row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantiere.functions.text import blank_to_null, squeeze
from cantiere.functions.values import has_text


def top_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int = 1,
                rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every key in the given order."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(spec)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[Column | str], position: Sequence[Column | str]) -> DataFrame:
    """First seen per key; ``position`` must be a real, total order of the input."""
    return top_per_key(df, keys, [F.asc(p) if isinstance(p, str) else p for p in position])


def max_value_per_key(df: DataFrame, key: Column, value: Column, position: Sequence[Column]) -> DataFrame:
    """Largest value per key, the first one wins ties; rows without a key are dropped."""
    return (
        df.withColumn("_key", key).filter(F.col("_key").isNotNull())
        .transform(lambda d: top_per_key(d, ["_key"], [F.desc_nulls_last(F.coalesce(value, F.lit(0.0))), *position]))
        .drop("_key")
    )


def best_target(df: DataFrame, key: str = "cup", score: str = "operational_score", value: str = "value_eur",
                title: str = "title", position: Sequence[Column] = ()) -> DataFrame:
    """Best candidate per project: score, then value, then a title."""
    upper = F.upper(F.trim(F.col(key)))
    return top_per_key(
        df.withColumn(key, upper).filter(has_text(F.col(key))),
        [key],
        [F.desc(F.coalesce(F.col(score), F.lit(0))), F.desc(F.coalesce(F.col(value), F.lit(0.0))),
         F.desc(has_text(F.col(title)).cast("int")), *position],
    )


def identity_key(cup: Column, cig: Column, record_id: Column, title: Column, client: Column, municipality: Column,
                 province: Column, value: Column) -> Column:
    """Record identity: project code, tender code, id, else a hash of five fields."""
    norm = lambda c: F.upper(F.coalesce(F.trim(c.cast("string")), F.lit("")))
    tag = lambda name, c: F.concat(F.lit(f"{name}::"), F.upper(blank_to_null(c.cast("string"))))
    digest = F.sha1(F.concat_ws("|", norm(title), norm(client), norm(municipality), norm(province),
                                F.coalesce(F.trim(value.cast("string")), F.lit(""))))
    return F.coalesce(tag("CUP", cup), tag("CIG", cig), tag("ID", record_id), F.concat(F.lit("HASH::"), digest))


def row_key(cup: Column, cig: Column, title: Column, municipality: Column) -> Column:
    """Simpler key: code pair, code, or title and place."""
    up = lambda c: F.upper(blank_to_null(c))
    none = F.lit("")
    return F.coalesce(
        F.concat(F.lit("CUP_CIG::"), up(cup), F.lit("::"), up(cig)),
        F.concat(F.lit("CUP::"), up(cup)),
        F.concat(F.lit("TITLE::"), F.coalesce(up(title), none), F.lit("::"), F.coalesce(up(municipality), none)),
    )


def duplicate_codes(df: DataFrame, code: str, top: int | None = 25) -> DataFrame:
    """Codes that occur more than once, most frequent first."""
    out = (
        df.groupBy(F.upper(squeeze(F.col(code))).alias(code)).agg(F.count(F.lit(1)).alias("count"))
        .filter((F.col("count") > 1) & (F.col(code) != ""))
        .orderBy(F.desc("count"), F.asc(code))
    )
    return out if top is None else out.limit(top)
