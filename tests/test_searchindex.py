"""Search index: the same rows as a scan, from fewer blocks."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cantiere.operators import search
from cantiere.operators.search import SearchRequest
from cantiere.operators.searchindex import SearchIndex

COLUMNS = ["title", "region", "branch", "cup"]
REQUESTS = [
    SearchRequest(), SearchRequest(region="R1"), SearchRequest(branch="B2"), SearchRequest(branch="B2", region="R0", value_min=100), SearchRequest(value_max=40, value_min=35),
    SearchRequest(text="Scuola 77"), SearchRequest(text="zz"), SearchRequest(text="ol"), SearchRequest(date_from="2020-02-01", date_to="2020-02-03"), SearchRequest(text="nulla di ciò"),
    SearchRequest(segment="S1", text="PONTE 1"), SearchRequest(region="none"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"C{i:04}", None if i % 50 == 0 else f"{'Scuola' if i % 2 else 'Ponte'} {i}", f"R{i % 3}", "AMBIGUA" if i % 9 == 0 else f"B{i % 4}", "B2 | B3" if i % 9 == 0 else "", f"S{i % 5}",
             None if i % 31 == 0 else float(i % 400), f"2020-0{1 + i % 3}-0{1 + i % 7}" if i % 13 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "cup string, title string, region string, branch string, branch_candidates string, segment string, value_eur double, award_date string")
    return df.withColumn("award_date", F.col("award_date").cast("date"))


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    out = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), COLUMNS)
    out.build(table, ["branch", "value_eur", "cup"], 20)
    return out


@pytest.mark.parametrize("request_", REQUESTS)
def test_same_rows_as_a_scan(table, index, request_):
    order = [F.desc_nulls_last("value_eur"), F.asc("cup")]
    want = search.search(table, request_, order, 2000, text_columns=COLUMNS).collect()
    assert [r["cup"] for r in index.search(request_, order, 2000).collect()] == [r["cup"] for r in want]


def test_only_candidate_blocks_are_read(index):
    assert index.read().select("block").distinct().count() == 45 and index.candidates(SearchRequest()).count() == 45
    assert index.candidates(SearchRequest(text="Scuola 77")).count() < 12 and index.candidates(SearchRequest(region="none")).count() == 0
    narrow = SearchRequest(branch="B1", value_min=100, value_max=120)
    assert index.candidates(narrow).count() <= 3
    plan = index.search(narrow, [F.asc("cup")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block" in plan.split("PartitionFilters")[1][:120]


def test_neighbouring_blocks_share_a_folder(spark, table, tmp_path):
    """900 rows in blocks of 20 are few files, and a reader of one block passes over the others of its folder."""
    index = SearchIndex(spark, str(tmp_path), COLUMNS)
    index.build(table, ["branch", "value_eur", "cup"], 20)
    files = list(tmp_path.glob("rows/**/*.parquet"))
    assert len(files) <= 8 and len(list(tmp_path.glob("rows/*=*"))) == 1
    metadata = pq.ParquetFile(max(files, key=lambda f: f.stat().st_size)).metadata
    assert metadata.row_group(0).column(0).has_offset_index or metadata.row_group(0).num_rows <= 20
    assert {r["n"] for r in index.read().groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()} == {20}


def test_grams_of_odd_texts(spark, tmp_path):
    texts = [(0, "ab"), (0, ""), (1, "Perché è così"), (0, "perché"), (1, "😀😀😀 x\u0000y"), (0, "aaaa"), (1, "x" * 40_000)]
    found = SearchIndex(spark, str(tmp_path), ["t"])._terms(spark.createDataFrame(texts, "block long, t string").coalesce(1)).collect()
    low = [(b, t.lower()) for b, t in texts]
    want = {(b, t[i:i + 3]) for b, t in low for i in range(max(len(t) - 2, 1))}
    assert {(r["block"], r["value"]) for r in found} == want and len(found) == len(want) and {r["facet"] for r in found} == {"text"}
