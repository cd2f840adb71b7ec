"""Versioned snapshots in an extendible hash directory, compared by digests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiere.operators.snapshot import as_snapshot, delta, upsert
from cantiere.session import scratch_dir

#: Rows of a bucket above which it is split when it is written again.
BUCKET_ROWS = 1_000_000


class Bucket(NamedTuple):
    """Rows whose key hash ends with the ``depth`` bits of ``code``; digests do not depend on their order."""

    depth: int
    code: int
    written_in: int | None = None
    rows: int = 0
    hash_sum: int = 0
    hash_xor: int = 0

    @property
    def name(self) -> str:
        return f"{self.depth}-{self.code}"

    def parts(self, rows: int, limit: int) -> list[Bucket]:
        """The bucket itself, or as many equal children as ``rows`` need under ``limit``."""
        bits = max(0, -(-rows // limit) - 1).bit_length()
        return [Bucket(self.depth + bits, self.code + (i << self.depth)) for i in range(1 << bits)]


class SnapshotTable:
    """Parquet snapshot kept as numbered versions; every version lists its buckets and where each was last written.

    Buckets are those of an extendible hash: each has a depth of its own, and one that has outgrown ``bucket_rows`` is
    split into children when it is rewritten.  A batch rewrites only the buckets of its
    keys, a new state only those whose digest differs; all other files stay as they are.  The list (one row per
    bucket) is written last: a run that dies half-way leaves an unlisted folder, readers keep the last listed version.

    The buckets a version writes lie side by side in its files, in order and named in a column, so the number of files
    follows from the size of the data and not from that of the buckets.
    """

    LOG = "version long, run_id string, depth int, code long, written_in long, rows long, hash_sum decimal(38,0), hash_xor long"
    DIGEST, PLACE = "_digest", "_place"
    #: Buckets that a reader names in a filter, which parquet can use to pass over row groups; more are joined.
    NAMED = 1_000

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS, key: str = "record_key"):
        self.spark, self.path, self.bucket_rows, self.key = spark, path.rstrip("/"), bucket_rows, key

    # -- directory

    def _log(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.LOG).parquet(f"{self.path}/_log/*")
        except AnalysisException:
            return None

    def latest(self) -> int | None:
        log = self._log()
        return None if log is None else log.agg(F.max("version")).first()[0]

    def directory(self, version: int | None = None) -> list[Bucket]:
        """Buckets of a version (the latest): one entry per ``bucket_rows`` rows or so; empty if nothing is listed."""
        version = self.latest() if version is None else version
        if version is None:
            return []
        rows = self._log().filter(F.col("version") == version).drop("version", "run_id").collect()
        return sorted((Bucket(r["depth"], r["code"], r["written_in"], r["rows"], int(r["hash_sum"]), r["hash_xor"]) for r in rows), key=lambda b: b[:2])

    def _bucket(self, df: DataFrame, buckets: Iterable[Bucket]) -> DataFrame:
        """Add the name of each row's bucket; ``buckets`` cover the hashes of all rows."""
        buckets = list(buckets)
        depths = sorted({b.depth for b in buckets})
        code = F.xxhash64(self.key).bitwiseAND(F.expr("shiftleft(1L, _depth) - 1"))
        if len(depths) == 1:
            return df.withColumn("_depth", F.lit(depths[0])).withColumn("bucket", F.concat_ws("-", "_depth", code)).drop("_depth")
        listed = self.spark.createDataFrame([(b.name,) for b in buckets], "bucket string")
        tried = df.withColumn("_depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("bucket", F.concat_ws("-", "_depth", code)).drop("_depth")
        # as many rows as the directory has buckets
        return tried.join(F.broadcast(listed), "bucket", "left_semi")

    def _digests(self, df: DataFrame) -> dict[str, Bucket]:
        """Count, sum and exclusive or of the row digests per bucket."""
        found = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(self.DIGEST).cast("decimal(20,0)")).alias("total"), F.bit_xor(self.DIGEST).alias("mixed"))
        return {r["bucket"]: Bucket(*map(int, r["bucket"].split("-")), None, r["rows"], int(r["total"]), r["mixed"]) for r in found.collect()}

    def _with_digest(self, df: DataFrame) -> DataFrame:
        names = sorted(df.columns)
        return df.withColumn(self.DIGEST, F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})))

    # -- reading and writing

    def read(self, only: Iterable[Bucket] | None = None, version: int | None = None) -> DataFrame | None:
        """A version (the latest), or some of its buckets; None if nothing is listed, no rows if those are empty."""
        listed = self.directory(version)
        stored = [b for b in listed if b.written_in is not None]
        if not stored:
            return None
        names = None if only is None else {b.name for b in only}
        wanted = [b for b in stored if names is None or b.name in names]
        versions = sorted({b.written_in for b in wanted or stored[:1]})
        rows = self.spark.read.parquet(*[f"{self.path}/v={v}" for v in versions])
        if not wanted:
            rows = self.spark.createDataFrame([], rows.schema)
        elif len(wanted) < self._written(versions):
            places = [self._place(b) for b in wanted]
            if len(places) <= self.NAMED:
                rows = rows.filter(F.col(self.PLACE).isin(places))
            else:  # one row per bucket
                rows = rows.join(F.broadcast(self.spark.createDataFrame([(p,) for p in places], f"{self.PLACE} string")), self.PLACE, "left_semi")
        return rows.drop(self.DIGEST, self.PLACE)

    def _written(self, versions: Sequence[int]) -> int:
        """Buckets that the files of some versions hold, also those that a later version has written again."""
        return self._log().filter(F.col("version").isin(*versions) & (F.col("version") == F.col("written_in"))).count()

    @staticmethod
    def _place(b: Bucket) -> str:
        return f"{b.written_in}:{b.name}"

    def _landed(self, df: DataFrame) -> DataFrame:
        """Rows written down once, so that counting or comparing them does not compute them again."""
        path = scratch_dir(self.spark, "state")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, df: DataFrame, run_id: str) -> int:
        """Write all rows as a new version in buckets of their own."""
        df = self._landed(df)
        return self._store(df, run_id, Bucket(0, 0).parts(df.count(), self.bucket_rows), [])

    def _store(self, df: DataFrame, run_id: str, targets: Sequence[Bucket], keep: Sequence[Bucket]) -> int:
        """A new version: ``df`` fills ``targets``, ``keep`` stays where it is."""
        version = (self.latest() or 0) + 1
        folder, listed = f"{self.path}/v={version}", list(keep)
        if targets:
            rows = self._with_digest(df)
            placed = self._bucket(rows, targets).withColumn(self.PLACE, F.concat_ws(":", F.lit(str(version)), "bucket")).drop("bucket")
            placed.repartition(self.PLACE).sortWithinPartitions(self.PLACE).write.mode("overwrite").parquet(folder)
            stored = self.spark.read.schema(f"{self.DIGEST} long, {self.PLACE} string").parquet(folder)
            written = self._digests(stored.withColumn("bucket", F.substring_index(self.PLACE, ":", -1)))
            listed += [written[t.name]._replace(written_in=version) if t.name in written else t for t in targets]
        entries = [(version, run_id, *b._replace(hash_sum=Decimal(b.hash_sum))) for b in sorted(listed, key=lambda b: b[:2])]
        log = self.spark.createDataFrame(entries, self.LOG)
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_log/{version}")
        return version

    def merge(self, batch: DataFrame, run_id: str, now: Column, source: str, position: Sequence[Column]) -> int:
        """Upsert a partial batch; only the buckets of its keys are read, joined and rewritten."""
        listed = self.directory()
        if not listed:
            return self.write(as_snapshot(batch, run_id, now), run_id)
        added = Counter({r["bucket"]: r["count"] for r in self._bucket(batch.select(self.key), listed).groupBy("bucket").count().collect()})
        touched = [b for b in listed if b.name in added]
        known = self.read(touched)
        rows = as_snapshot(batch, run_id, now) if known is None else upsert(known, batch, source, run_id, now, position, deactivate=False)
        targets = [part for b in touched for part in b.parts(b.rows + added[b.name], self.bucket_rows)]
        return self._store(rows, run_id, targets, [b for b in listed if b.name not in added])

    def replace(self, df: DataFrame, run_id: str) -> int:
        """A new state of the whole table; only buckets whose digest differs from the stored one are written."""
        listed = self.directory()
        if not listed:
            return self.write(df, run_id)
        df = self._landed(df)
        now = self._digests(self._bucket(self._with_digest(df), listed))
        same = lambda b: b[3:] == (now[b.name][3:] if b.name in now else (0, 0, 0))
        changed = [b for b in listed if not same(b)]
        if not changed:
            return self._store(df, run_id, [], listed)
        names = self.spark.createDataFrame([(b.name,) for b in changed], "bucket string")
        rows = self._bucket(df, listed).join(F.broadcast(names), "bucket", "left_semi").drop("bucket")
        targets = [part for b in changed for part in b.parts(now[b.name].rows if b.name in now else 0, self.bucket_rows)]
        return self._store(rows, run_id, targets, [b for b in listed if same(b)])


# -- comparison --------------------------------------------------------------


def _cells(one: Sequence[Bucket], two: Sequence[Bucket]) -> dict[tuple[int, int], tuple[list[Bucket], list[Bucket]]]:
    """The buckets of two directories under the coarser of the ones that overlap."""
    def above(b: Bucket, others: set[tuple[int, int]]) -> tuple[int, int]:
        """The bucket of the other directory that holds this one, else this one."""
        return next(((d, b.code & ((1 << d) - 1)) for d in range(b.depth + 1) if (d, b.code & ((1 << d) - 1)) in others), b[:2])

    places: tuple = ({b[:2] for b in two}, {b[:2] for b in one})
    out: dict[tuple[int, int], tuple[list[Bucket], list[Bucket]]] = {}
    for side, buckets in enumerate((one, two)):
        for b in buckets:
            out.setdefault(above(b, places[side]), ([], []))[side].append(b)
    return out


def _digest(buckets: Sequence[Bucket]) -> tuple[int, int, int]:
    """Digest of several buckets together: counts and sums add, exclusive ors combine."""
    mixed = 0
    for b in buckets:
        mixed ^= b.hash_xor
    return sum(b.rows for b in buckets), sum(b.hash_sum for b in buckets), mixed


def compare(previous: SnapshotTable, current: SnapshotTable, previous_version: int | None = None,
            current_version: int | None = None) -> tuple[list[Bucket], list[Bucket], list[Bucket]]:
    """Old and new buckets that differ, and new buckets with equal rows; read from the directories alone."""
    old, new, equal = [], [], []
    for before, after in _cells(previous.directory(previous_version), current.directory(current_version)).values():
        if _digest(before) == _digest(after):
            equal += after
        else:
            old += before
            new += after
    return old, new, equal


def stored_delta(previous: SnapshotTable, current: SnapshotTable, previous_version: int | None = None, current_version: int | None = None,
                 unchanged: bool = True) -> DataFrame:
    """Change status per identity key between two stored states (rows of ``keyed_state``).

    Only buckets with different digests are joined.  Of equal ones the key and branch are read, or nothing without ``unchanged``.
    """
    old, new, equal = compare(previous, current, previous_version, current_version)
    out = []
    if old or new:
        before, after = previous.read(old, previous_version), current.read(new, current_version)
        if before is None or after is None:
            empty = (after if before is None else before).limit(0)
            before, after = empty if before is None else before, empty if after is None else after
        out.append(delta(before, after))
    if unchanged and any(b.rows for b in equal):
        out.append(current.read(equal, current_version).select("identity_key", F.lit("unchanged").alias("change_status"), "branch"))
    if not out:
        return current.spark.createDataFrame([], "identity_key string, change_status string, branch string")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def signed_changes(previous: SnapshotTable, current: SnapshotTable, previous_version: int | None = None, current_version: int | None = None) -> DataFrame:
    """Rows of the buckets that differ with ``sign``: 1 for the new ones, -1 for the old ones.

    Unchanged rows of such a bucket stand on both sides and cancel out in sums.
    """
    old, new, _ = compare(previous, current, previous_version, current_version)
    before, after = previous.read(old, previous_version), current.read(new, current_version)
    sides = [df.withColumn("sign", F.lit(s)) for df, s in ((before, -1), (after, 1)) if df is not None]  # no rows where nothing differs
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
