"""Stored snapshots: splitting buckets, digests, changes between versions."""

import random

import pytest
from pyspark.sql import functions as F

from cantiere.operators import report, snapshot, store
from cantiere.operators.store import Bucket, SnapshotTable


def load(t, rows, run):
    """Merge a batch of source ``s``."""
    return t.merge(rows, run, F.current_timestamp(), "s", [F.asc("v")])


def table(spark, path, rows=1000, key="record_key"):
    return SnapshotTable(spark, str(path), rows, key)


def batch(spark, keys, v=0):
    return spark.createDataFrame([(k, "s", v) for k in keys], "record_key string, source string, v int")


def files(path):
    return {f: f.read_bytes() for f in path.rglob("bucket=*/*.parquet")}


def placed(t, version=None):
    return {b.name: b.written_in for b in t.directory(version)}


def test_unlisted_versions_are_not_read(spark, tmp_path):
    t = table(spark, tmp_path / "t", key="id")
    assert t.read() is None
    t.write(spark.range(3), "a")
    spark.range(99).write.parquet(str(tmp_path / "t" / "v=2" / "bucket=0-0"))  # a run that died before its log row
    assert t.read().count() == 3
    assert t.write(t.read().filter("id > 0"), "b") == 2 and t.read().count() == 2 and t.read(version=1).count() == 3


def test_buckets_split_and_others_stay(spark, tmp_path):
    t = table(spark, tmp_path / "t", 40)
    keys = [f"k{i}" for i in range(100)]
    load(t, batch(spark, keys), "r1")
    assert set(placed(t)) == {"2-0", "2-1", "2-2", "2-3"} and sum(b.rows for b in t.directory()) == 100
    name = t._bucket(batch(spark, ["k7"]), t.directory()).first()["bucket"]
    more = [k for k, b in ((r["record_key"], r["bucket"]) for r in t._bucket(batch(spark, [f"n{i}" for i in range(500)]), t.directory()).collect()) if b == name]
    before = files(tmp_path / "t")
    load(t, batch(spark, ["k7", *more], 1), "r2")
    depth = max(b.depth for b in t.directory())
    assert depth > 2 and all(b.rows <= 80 for b in t.directory()) and {n: v for n, v in placed(t).items() if v == 1} == {n: 1 for n in placed(t, 1) if n != name}
    assert all(f.read_bytes() == old for f, old in before.items())
    got = {r["record_key"]: (r["v"], r["last_run_id"]) for r in t.read().collect()}
    assert len(got) == 100 + len(more) and got["k7"] == (1, "r2") and got[more[0]] == (1, "r2") and got["k8"][1] in ("r1",)
    # buckets of different depth: keys still find theirs
    load(t, batch(spark, keys[:50], 2), "r3")
    got = {r["record_key"]: r["v"] for r in t.read().collect()}
    assert len(got) == 100 + len(more) and all(got[k] == 2 for k in keys[:50]) and got[more[-1]] == 1
    load(t, batch(spark, []), "r4")
    assert t.read().count() == 100 + len(more)


def test_replace_writes_changed_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path / "t", 20)
    rows = batch(spark, [f"k{i}" for i in range(200)])
    t.replace(rows, "a")
    t.replace(rows.select("v", "source", "record_key").repartition(3), "b")  # order of rows and columns does not matter
    assert placed(t, 1) == placed(t, 2)
    t.replace(rows.filter("record_key <> 'k3'").withColumn("v", F.when(F.col("record_key") == "k9", None).otherwise(F.col("v"))), "c")
    assert 1 <= sum(v == 3 for v in placed(t).values()) <= 2
    assert t.read().count() == 199 and t.read().filter("v IS NULL").count() == 1 and t.read(version=2).count() == 200
    t.replace(rows.limit(0), "d")
    assert t.read() is None or t.read().count() == 0


def test_cells_of_different_depth():
    one = [Bucket(1, 0), Bucket(2, 1), Bucket(2, 3)]
    two = [Bucket(2, 0), Bucket(3, 2), Bucket(3, 6), Bucket(1, 1)]
    cells = store._cells(one, two)
    assert {k: (sorted(x[:2] for x in a), sorted(x[:2] for x in b)) for k, (a, b) in cells.items()} == {
        (1, 0): ([(1, 0)], [(2, 0), (3, 2), (3, 6)]), (1, 1): ([(2, 1), (2, 3)], [(1, 1)])}


STATE = "identity_key string, signature string, has_contractor boolean, branch string"


def states(spark, seed):
    rng = random.Random(seed)
    old = {f"k{i}": (f"s{i % 7}", i % 3 == 0, f"B{i % 4}") for i in range(300)}
    new = dict(old)
    for k in rng.sample(sorted(old), 12):
        new.pop(k)
    for k in rng.sample(sorted(new), 9):
        new[k] = (new[k][0] + "x", rng.random() < 0.5, new[k][2])
    new |= {f"n{i}": ("s", True, "B9") for i in range(5)}
    return [spark.createDataFrame([(k, *v) for k, v in x.items()], STATE) for x in (old, new)]


@pytest.mark.parametrize("limits", [(30, 30), (30, 120), (500, 20)])
def test_stored_delta_equals_the_join(spark, tmp_path, limits):
    old, new = states(spark, 1)
    a, b = (table(spark, tmp_path / n, limit, "identity_key") for n, limit in zip("ab", limits))
    a.write(old, "a")
    b.write(new, "b")
    want = sorted(map(tuple, snapshot.delta(old, new).collect()))
    assert sorted(map(tuple, store.stored_delta(a, b).collect())) == want
    assert sorted(map(tuple, store.stored_delta(a, b, unchanged=False).filter("change_status <> 'unchanged'").collect())) == [r for r in want if r[1] != "unchanged"]


def test_an_unchanged_register_reads_no_payload(spark, tmp_path):
    old, _ = states(spark, 2)
    t = table(spark, tmp_path / "t", 50, "identity_key")
    t.replace(old, "a")
    t.replace(old, "b")
    plan = store.stored_delta(t, t, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<identity_key:string,branch:string>" in plan and "signature" not in plan and "Join" not in plan
    assert "ReadSchema" not in store.stored_delta(t, t, 1, 2, unchanged=False)._jdf.queryExecution().executedPlan().toString()
    assert {r[1] for r in store.stored_delta(t, t, 1, 2).collect()} == {"unchanged"} and store.stored_delta(t, t, 1, 2).count() == 300


def test_sums_after_changes_equal_a_full_pass(spark, tmp_path):
    rng = random.Random(3)
    value = lambda: (f"B{rng.randrange(5)}", rng.choice([None, 1.25, 1e6 / 3, 80.1]), rng.random() < 0.4)
    rows = {f"k{i}": value() for i in range(200)}
    t, sums = table(spark, tmp_path / "t", 25, "cup"), None
    for month in range(4):
        df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "cup string, branch string, value_eur double, has_contractor boolean").withColumn("odd", F.col("value_eur").isNull())
        version = t.replace(df, str(month))
        if sums is None:
            sums = report.kpi_sums(t.read(), ["branch"], flags=["odd"])
        else:
            sums = report.add_sums(sums, report.kpi_sums(store.signed_changes(t, t, version - 1, version), ["branch"], sign=F.col("sign"), flags=["odd"]), ["branch"])
        sums = spark.createDataFrame(sums.collect(), sums.schema)
        assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, report.kpi_sums(df, ["branch"], flags=["odd"]).collect()))
        assert sorted(map(tuple, report.kpis_of_sums(sums, ["branch"]).collect())) == sorted(map(tuple, report.kpis(df, ["branch"]).collect()))
        for k in rng.sample(sorted(rows), 6):
            rows[k] = value()
        rows = {k: v for k, v in rows.items() if rng.random() > 0.02 and (month < 2 or v[0] != "B2")}
        rows |= {f"m{month}-{i}": value() for i in range(4)}


def test_files_follow_from_the_data_not_from_the_buckets(spark, tmp_path):
    t = table(spark, tmp_path / "t", 5)
    rows = batch(spark, [f"k{i}" for i in range(1000)])
    t.replace(rows, "a")
    t.replace(rows.withColumn("v", F.when(F.col("record_key") == "k9", 1).otherwise(F.col("v"))), "b")
    assert len(t.directory()) >= 128 and len(list((tmp_path / "t").rglob("v=*/**/*.parquet"))) <= 16
    assert t.read().count() == 1000 and {r["record_key"] for r in t.read().filter("v = 1").collect()} == {"k9"}
    some = [b for b in t.directory() if b.written_in == 1][:3]
    assert t.read(some).count() == sum(b.rows for b in some) and t.read(version=1).filter("v = 1").count() == 0
    t.NAMED = 2
    assert t.read(some).count() == sum(b.rows for b in some)
