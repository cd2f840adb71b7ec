"""Inputs that the small test tables do not hold: files of several splits, repeated urls, long codes."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cantiere.functions import text as T
from cantiere.operators import awards, geo, link, scale
from cantiere.operators.scale import TASK_BYTES, bounded_tasks
from cantiere.plans import bindings as B
from cantiere.sources import files
from oracle import TABLES, compare, duck


@pytest.fixture
def tables(spark, sf, tmp_path):
    """A copy of the test tables by links, with some of them replaced."""
    def make(**replaced):
        for t in TABLES:
            if t in replaced:
                replaced[t].toPandas().to_parquet(tmp_path / f"{t}.parquet")
            else:
                os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


def test_file_of_several_splits(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = spark.range(4000).select(F.col("id").cast("string").alias("a"), F.lit("x" * 40).alias("b"))
    files.write_delimited(rows.coalesce(1), path, ["a", "b"], bom=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        back = files.read_delimited(spark, path)
        assert back.columns == ["a", "b"] and back.select("a").distinct().count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_url_fetched_several_times(spark, tables):
    html = lambda i: f"<html><h1>Titolo {i}</h1><p>testo</p></html>"
    pages = spark.createDataFrame([(i, "https://a.example/en/7", html(i)) for i in (5, 3, 9)], "page_id long, url string, html string")
    out = entry.queries()["page_features"](spark, tables(pages=pages)).collect()
    assert [r["title"] for r in out] == ["Titolo 3"]


def test_postal_codes_of_six_digits(spark, sf, tables):
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    more = customer.withColumn("c_custkey", F.col("c_custkey") + 400_000)
    folder = tables(customer=customer.unionByName(more))
    name = "postal_place_resolution"
    assert compare(duck(folder), entry.oracle_sql()[name], entry.queries()[name](spark, folder)) is None


def test_places_are_assigned_once(spark):
    town = [("alfa", "uno", "R"), ("beta", None, "R"), (None, None, None), ("gamma", "due", None)]
    df = spark.createDataFrame([(i, *town[i % 4]) for i in range(40)], "i int, municipality string, province string, region string")
    rows = spark.createDataFrame([("ALFA", "UNO", "alfa", "uno", "B1", "B1", "alta", 1), ("BETA", "TRE", "beta", "tre", "B2", "B2", "alta", 2)],
                                 "municipality_norm string, province_norm string, municipality string, province string, branch string, branch_candidates string, confidence string, pos int")
    want = sorted(map(tuple, geo.assign_branch(df, rows, ["pos"]).collect()), key=str)
    for limit in (0, 100):
        assert sorted(map(tuple, geo.assign_places(df, rows, ["pos"], limit).collect()), key=str) == want
    plan = geo.assign_places(df, rows, ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("BroadcastHashJoin") == 1


def test_squeeze_of_even_and_uneven_texts(spark):
    texts = [None, "", " ", "a", " a", "a ", "a b", "a  b", "a\n", "\na", "a\tb", "a\x1fb", "a\xa0b", "\u2003", "è", "è b", "a\r\n b", "x " * 30_000, "~ !", "\x01", "a \x01 b"]
    want = [None if t is None else " ".join(t.split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.squeeze(F.col("t")).alias("s"))
    assert [r["s"] for r in df.orderBy("i").collect()] == want


def test_segments_are_generated_code(spark, sf):
    plan = B.segmented(B.projects(spark, sf)).select("primary_segment")._jdf.queryExecution().executedPlan().toString()
    assert "primary_segment" in plan and "arrays_overlap" not in plan and "lambdafunction" not in plan


@pytest.mark.parametrize("name, scans", [("award_consolidation", 2), ("project_contractors", 2)])
def test_contractor_rows_are_read_once(spark, sf, name, scans):
    """Readers of one intermediate result share its exchange: no more scans of the large table than different uses of it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum("FileScan" in line and "lineitem" in line for line in plan.splitlines()) == scans


@pytest.mark.parametrize("name", ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"])
def test_tasks_are_bounded(spark, sf, name):
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "128m")
        B.table(spark, sf, "nation")
        assert spark.conf.get(name) == str(TASK_BYTES)
        spark.conf.set(name, "32k")
        bounded_tasks(spark)
        assert spark.conf.get(name) == "32k"
    finally:
        spark.conf.set(name, before)


def shuffle_files(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in blocks.localDirs() for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_landing_leaves_no_shuffle_files(spark, tmp_path):
    before, setting = shuffle_files(spark), spark.conf.get(B.SHUFFLE_CLEANUP)
    out = B.land(spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count().orderBy("k"), "kept")
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and out.count() == 97 and spark.conf.get(B.SHUFFLE_CLEANUP) == setting


def test_awards_of_a_project_are_sent_once(spark):
    """Consolidation of rows that lie together by project needs no further exchange; both results come from the kept table."""
    rows = spark.createDataFrame(
        [("P1", "T1", 900.0, "N1", 1), ("P1", "T1", 900.0, "N2", 0), ("P1", "T1", 900.0, "N1", 3), ("P1", "T2", 700.0, None, 0), ("P2", "T1", 10.0, "N1", 0)],
        "cup string, cig string, award_amount_eur double, contractor_name string, pos int").withColumns({
            **{c: F.lit(None).cast("string") for c in ("contractor_tax_code", "contractor_vat", "contractor_role")}, "value_eur": F.lit(1000.0), "award_result": F.lit("AGGIUDICATA")})
    kept = []
    c, members = awards.consolidate(rows.repartition(3, "cup"), [F.asc("pos")], 100.0, keep=lambda df: kept.append(df) or df)
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 1 and plan.count("Exchange") == 1 and "hashpartitioning(cup" in plan
    found = {(r["cup"], r["cig"]): (r["pos"], r["contractors_count"], r["contractor_set"]) for r in c.collect()}
    assert set(found) == {("P1", "T1"), ("P1", "T2")} and found["P1", "T2"] == (0, 0, None) and found["P1", "T1"][:2] == (0, 2)
    assert sorted((r["set_id"], r["item"]["name"]) for r in members.collect()) == [(found["P1", "T1"][2], n) for n in ("N1", "N2")]


def test_lists_are_gathered_after_one_join(spark):
    """Items are sent for being distinct and for the totals, and a third time only for keys of several parts. NULL keys have lists, too."""
    df = spark.createDataFrame([("a", None, 2), ("a", None, 1), (None, "x", 3), (None, "x", 3), *[("hot", "y", i) for i in range(30)], ("b", "z", None)], "k string, l string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = scale.lists_per_key(df, ["k", "l"], F.col("v"), limit=10)
        plan = lists._jdf.queryExecution().executedPlan().toString()
        found = lists.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    made = [x for x in plan.splitlines() if "collect_list(" in x or "Exchange hashpartitioning(" in x]
    first = next(i for i, x in enumerate(made) if "collect_list(" in x)
    assert "partial_collect_list(" in made[first + 1]
    assert sorted(((r["k"], r["l"], r["part"], r["items"], r["n_items"]) for r in found if r["k"] != "hot"), key=str) == [("a", None, 0, [1, 2], 2), (None, "x", 0, [3], 1)]
    hot = [r for r in found if r["k"] == "hot"]
    assert {r["n_items"] for r in hot} == {30} and len({r["part"] for r in hot}) == len(hot) > 1 and sorted(v for r in hot for v in r["items"]) == list(range(30))


def test_lists_are_sent_once_per_tender(spark, sf):
    """Pairs get their metadata before the lists, so no exchange by project carries a list; the lists are computed once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        profile = spark.createDataFrame([("T1", 0, ["a", "b"], 2), ("T2", 0, ["c"], 1), ("T3", 0, ["d"], 1)], "cig string, part int, contractors array<string>, n_contractors long")
        links = spark.createDataFrame([("P1", "T1"), ("P1", "T1"), ("P2", "T1"), ("P2", "T2"), ("P9", "T2"), ("P1", "T8")], "cup string, cig string")
        meta = spark.createDataFrame([("P1", "x"), ("P2", "y"), ("P2", "z")], "cup string, title string")
        out = link.contractors_by_project(profile, links, meta)
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        found = sorted((tuple(r) for r in out.select("cup", "cig", "title", "contractors").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_project = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(cup" in line]
    lists = [i for i, line in enumerate(plan) if "Scan" in line and "contractors#" in line]
    deep = lambda i: len(plan[i]) - len(plan[i].lstrip(" :+-*"))
    below = [(i, j) for i in by_project for j in lists if i < j and all(deep(k) > deep(i) for k in range(i + 1, j + 1))]
    assert by_project and lists and not below
    assert found == sorted([("P1", "T1", "x", ["a", "b"]), ("P2", "T1", "y", ["a", "b"]), ("P2", "T1", "z", ["a", "b"]), ("P2", "T2", "y", ["c"]),
                            ("P2", "T2", "z", ["c"]), ("P9", "T2", None, ["c"]), (None, "T3", None, ["d"])], key=str)
