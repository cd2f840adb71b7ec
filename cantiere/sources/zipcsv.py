"""Spark data source ``zipcsv``: delimited members of zip archives, one task per member.

A deflated member can only be read from its start, so a member is the unit of work; land the
table as Parquet before heavy use.  Rows are streamed in Arrow batches and
carry their position (``_file``, ``_member``, ``_row``).

:func:`cantiere.sources.files.read_zip` lists the archives through Spark, reads member names and
headers in tasks, and passes both as options: ``listing`` (archive and member of each task),
``columns``, ``delimiter`` (``auto`` or a character), ``candidates`` (order for ``auto``; ``;,`` is
the two-way choice of semicolon or comma) and ``positional`` (number of unnamed columns, the header is skipped).
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

DEFAULT_CANDIDATES = ";|\t,"
HEAD = 8192
BATCH = 8192


def pick_delimiter(sample: str, candidates: str = DEFAULT_CANDIDATES) -> str:
    """Most frequent candidate of the sample; ties by candidate order, ``;`` when none occurs."""
    best = max(candidates, key=sample.count)
    return best if sample.count(best) else ";"


def _filesystem(path: str):
    """File system and plain path of a qualified path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def list_members(archive: str, members: str) -> list[str]:
    import zipfile

    filesystem, plain = _filesystem(archive)
    with filesystem.open_input_file(plain) as raw, zipfile.ZipFile(raw) as z:
        if members == "largest":
            fit = [i for i in z.infolist() if i.filename.lower().endswith((".csv", ".txt"))]
            return [max(fit, key=lambda i: i.file_size).filename] if fit else []
        return [n for n in z.namelist() if n.lower().endswith(".csv")]


class _Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


def head_of(archive: str, member: str, delimiter: str, candidates: str) -> list[str]:
    """Header of a member."""
    rows = _open_rows(archive, member, delimiter, candidates)
    out = next(rows, [])
    rows.close()
    return out


def _open_rows(archive: str, member: str, delimiter: str, candidates: str):
    """Yield the csv rows of a member, header first."""
    import csv
    import io
    import zipfile

    csv.field_size_limit(1 << 30)
    filesystem, plain = _filesystem(archive)
    with filesystem.open_input_file(plain) as raw, zipfile.ZipFile(raw) as z:
        if delimiter == "auto":
            with z.open(member) as m:
                delimiter = pick_delimiter(m.read(HEAD).decode("utf-8-sig", errors="ignore"), candidates)
        with z.open(member) as m:
            text = io.TextIOWrapper(m, encoding="utf-8-sig", errors="ignore", newline="")
            yield from csv.reader(text, delimiter=delimiter)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [f.name for f in schema.fields if f.name not in ("_file", "_member", "_row")]
        self.names = [f.name for f in schema.fields]
        self.options = options

    def partitions(self):
        import json

        return [_Member(archive, member) for archive, member in json.loads(self.options["listing"])]

    def read(self, partition):
        import pyarrow as pa

        delimiter = self.options.get("delimiter", "auto")
        candidates = self.options.get("candidates", DEFAULT_CANDIDATES)
        rows = _open_rows(partition.archive, partition.member, delimiter, candidates)
        header = next(rows, None)
        if header is None:
            return
        if self.options.get("positional"):
            index = list(range(len(self.fields)))
        else:
            at = {name: i for i, name in enumerate(header)}
            index = [at.get(name, -1) for name in self.fields]
        schema = pa.schema([(n, pa.int64() if n == "_row" else pa.string()) for n in self.names])
        count, batch = 0, []

        def emit():
            data = {n: [r[i] if 0 <= i < len(r) else None for r in batch] for n, i in zip(self.fields, index)}
            size = len(batch)
            data["_file"] = [partition.archive] * size
            data["_member"] = [partition.member] * size
            data["_row"] = list(range(count - size + 1, count + 1))
            return pa.RecordBatch.from_pydict({n: data[n] for n in self.names}, schema=schema)

        for row in rows:
            if not row:
                continue
            batch.append(row)
            count += 1
            if len(batch) == BATCH:
                yield emit()
                batch = []
        if batch:
            yield emit()


class ZipCsv(DataSource):
    @classmethod
    def name(cls):
        return "zipcsv"

    def schema(self):
        import json

        place = [StructField("_file", StringType()), StructField("_member", StringType()), StructField("_row", LongType())]
        return StructType([StructField(c, StringType()) for c in json.loads(self.options["columns"])] + place)

    def reader(self, schema):
        return _Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("zipcsv")`` available."""
    import sys

    # ship this module with the source, executors need not have the package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ZipCsv)
