"""Delimited and JSON files, fallback chains, source signatures, run log."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiere.functions import presets as P
from cantiere.sources.zipcsv import DEFAULT_CANDIDATES, HEAD, head_of, list_members, pick_delimiter, register


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """``file, head``: the first 8 KiB of every file of a group, taken in tasks."""
    def heads(batches):
        import pandas as pd

        parts: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}
        for pdf in batches:
            for name, rows in pdf.groupby("file", sort=False):
                if sizes.get(name, 0) < HEAD:
                    text = "\n".join(rows["value"])
                    parts.setdefault(name, []).append(text)
                    sizes[name] = sizes.get(name, 0) + len(text) + 1
        if parts:  # a task may hold no file's first block; a frame without rows has no text columns
            yield pd.DataFrame({"file": list(parts), "head": ["\n".join(p)[:HEAD] for p in parts.values()]})

    # the first block of every file holds its head
    first = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    return first.filter("at = 0").select("value", "file").mapInPandas(heads, "file string, head string")


def read_delimited(spark: SparkSession, path: str, delimiter: str = "auto", multiline: bool = False,
                   candidates: str = DEFAULT_CANDIDATES) -> DataFrame:
    """Plain delimited files, all columns as text; short rows are padded with NULL.

    ``auto`` chooses the delimiter of every file from its own head; files of one delimiter are read
    together, the groups are joined by column name.
    """
    def load(sep: str, paths) -> DataFrame:
        return (
            spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).option("mode", "PERMISSIVE").csv(paths)
        )

    if delimiter != "auto":
        return load(delimiter, path)
    groups: dict[str, list[str]] = {}
    for r in file_heads(spark, path).orderBy("file").collect():  # names and samples only
        groups.setdefault(pick_delimiter(r["head"], candidates), []).append(r["file"])
    if len(groups) <= 1:
        return load(next(iter(groups), candidates[0]), path)
    out = None
    for sep, paths in sorted(groups.items()):
        rows = load(sep, paths)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_zip(spark: SparkSession, path: str, members: str = "all", delimiter: str = "auto", positional: int = 0,
             candidates: str = DEFAULT_CANDIDATES) -> DataFrame:
    """Zipped delimited files (file, folder or glob): all csv members, or the ``largest`` csv/txt member of
    each archive; see :mod:`cantiere.sources.zipcsv`.

    Spark lists the archives, so a path without a scheme lies on its default file system; member names
    and headers are read in tasks, one archive each.
    """
    register(spark)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.col("path").alias("archive"))

    def look(batches):
        import json

        import pandas as pd

        for pdf in batches:
            rows = [(a, i, m, "[]" if positional else json.dumps(head_of(a, m, delimiter, candidates)))
                    for a in pdf["archive"] for i, m in enumerate(list_members(a, members))]
            yield pd.DataFrame(rows, columns=["archive", "position", "member", "header"])

    names = archives.repartition(max(1, min(archives.count(), 1000)), "archive")
    found = names.mapInPandas(look, "archive string, position int, member string, header string").orderBy("archive", "position").collect()
    columns = [f"_c{i}" for i in range(positional)] or list(dict.fromkeys(c for r in found for c in json.loads(r["header"])))
    reader = spark.read.format("zipcsv").option("listing", json.dumps([(r["archive"], r["member"]) for r in found]))
    reader = reader.option("columns", json.dumps(columns)).option("delimiter", delimiter).option("candidates", candidates)
    if positional:
        reader = reader.option("positional", str(positional))
    return reader.load()


def read_register(spark: SparkSession, folder: str) -> DataFrame:
    """All zip archives of a folder, then its plain csv files, in that order (``_source_order``)."""
    frames = []
    for order, load in enumerate((lambda: read_zip(spark, folder), lambda: read_delimited(spark, f"{folder}/*.csv"))):
        try:
            df = load()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if df.columns and set(df.columns) - {"_file", "_member", "_row"}:
            frames.append(df.withColumn("_source_order", F.lit(order)))
    if not frames:
        raise FileNotFoundError(folder)
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write_delimited(df: DataFrame, path: str, fields: Sequence[str], sep: str = ";", bom: bool = False) -> None:
    """Fixed field list with header; absent fields are empty, extra columns are left out.

    ``bom`` puts the byte-order mark in front of the header, for spreadsheet programs.
    """
    cols = [F.col(f"`{f}`") if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    out = df.select(*cols)
    if bom:
        out = out.withColumnRenamed(fields[0], "﻿" + fields[0])
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def read_json_rows(spark: SparkSession, path: str, roots: Sequence[str] = P.JSON_ROOT_KEYS) -> DataFrame:
    """Rows of JSON documents: a list of records, or the first list under a known root key."""
    doc = spark.read.option("multiLine", True).json(path)
    lists = [r for r in roots if r in doc.columns and doc.schema[r].dataType.typeName() == "array"]
    if not lists:
        return doc
    out, earlier = None, F.lit(True)
    for r in lists:
        rows = doc.filter(earlier & F.col(r).isNotNull()).select(F.inline(F.col(r)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        earlier = earlier & F.col(r).isNull()
    return out


def write_json(df: DataFrame, path: str) -> None:
    """Nested records as JSON lines."""
    df.write.mode("overwrite").json(path)


def first_source(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """First source that exists, from (kind, path); kinds: parquet, json, delimited, zip."""
    loaders = {
        "parquet": lambda p: spark.read.parquet(p), "json": lambda p: read_json_rows(spark, p),
        "delimited": lambda p: read_delimited(spark, p), "zip": lambda p: read_zip(spark, p),
    }
    for kind, path in sources:
        try:
            return loaders[kind](path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {list(sources)}")


def peek(df: DataFrame, order: Sequence[Column], n: int = 3) -> DataFrame:
    """First ``n`` rows as (row, field, value), empty fields left out."""
    from pyspark.sql import Window

    head = df.orderBy(*order).limit(n)
    numbered = head.select(F.row_number().over(Window.orderBy(*order)).alias("row"),
                           *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return numbered.unpivot(["row"], df.columns, "field", "value").filter(F.coalesce(F.col("value"), F.lit("")) != "")


# -- source signatures -------------------------------------------------------


def file_signatures(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and modification time of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"),
                        F.col("modificationTime").alias("modified"))


def is_unchanged(current: DataFrame, stored: DataFrame | None) -> bool:
    """True when both listings hold the same files; an empty listing is never unchanged."""
    if stored is None or current.isEmpty():
        return False
    return current.exceptAll(stored).isEmpty() and stored.exceptAll(current).isEmpty()


def signature_report(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Status of every file against the stored listing."""
    keys = ["file_name"]
    c = current.select("file_name", F.struct("size_bytes", "modified").alias("c"))
    s = stored.select("file_name", F.struct("size_bytes", "modified").alias("s"))
    status = (
        F.when(F.col("s").isNull(), "added").when(F.col("c").isNull(), "removed")
        .when(F.col("c") == F.col("s"), "same").otherwise("changed")
    )
    return c.join(s, keys, "full_outer").select("file_name", status.alias("status"))


# -- run log -----------------------------------------------------------------


class RunLog:
    """Append-only Parquet log: one row when a run starts, one when it is finished."""

    SCHEMA = "run_id string, source string, event string, at timestamp, total_records long, note string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, values: Mapping) -> None:
        total = values.get("total_records")
        if isinstance(total, DataFrame):
            one, values = total.agg(F.count(F.lit(1)).alias("_n")), {**values, "total_records": F.col("_n")}
        else:
            one = self.spark.range(1)
        cell = lambda v: v if isinstance(v, Column) else F.lit(v)
        row = one.select(
            *[cell(values.get(c)).cast(t).alias(c) if c != "at" else F.current_timestamp().alias("at")
              for c, t in (f.split(" ") for f in self.SCHEMA.split(", "))]
        )
        row.write.mode("append").parquet(self.path)

    def start(self, run_id: str, source: str, note: str | None = None) -> None:
        self._append(dict(run_id=run_id, source=source, event="start", note=note))

    def finish(self, run_id: str, source: str, total_records: int | DataFrame) -> None:
        """Close a run with a number, or with a table whose rows are counted in the same plan."""
        self._append(dict(run_id=run_id, source=source, event="finish", total_records=total_records))

    def runs(self) -> DataFrame:
        log = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return log.groupBy("run_id", "source").agg(
            F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started_at"),
            F.max(F.when(F.col("event") == "finish", F.col("at"))).alias("completed_at"),
            F.coalesce(F.max("total_records"), F.lit(0)).alias("total_records"),
            F.max("note").alias("note"),
        )
