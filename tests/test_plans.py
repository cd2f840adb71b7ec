"""Physical plans: pushdown, join kinds, group limits, no Python workers in the hot path."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cantiere.functions import values as V
from cantiere.operators import dedupe, link, topk
from cantiere.plans import bindings as B

PYTHON_QUERIES = {"sharded_parts", "shard_index", "zip_csv_scan"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_semi_join_and_pruning(spark, sf):
    targets = B.projects(spark, sf).select("cup")
    text = plan(link.link_projects(B.links(spark, sf), targets))
    assert "LeftSemi" in text and "l_extendedprice" not in text


def test_top_k_is_not_a_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(topk.mid_market(B.with_commercial_score(B.projects(spark, sf)), B.MID_MARKET))


def test_best_of_key_limits_before_the_shuffle(spark, sf):
    text = plan(dedupe.first_per_key(B.table(spark, sf, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_partkey"]))
    assert text.count("WindowGroupLimit") == 2 and ", Partial" in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(B.register_as_of(spark, sf, "1996-01-01").filter(F.col("value_eur") > 1000.0))
    assert "GreaterThan(o_totalprice,1000.0)" in text


def test_diagnostics_use_one_aggregate(spark, sf):
    text = plan(entry.queries()["diagnostics_grouping_sets"](spark, sf))
    assert text.count("Expand") == 1 and text.count("HashAggregate") == 2


@pytest.mark.parametrize("name", ["operational_shortlist", "taxonomy_first_match", "award_consolidation", "snapshot_delta", "page_features", "link_sets"])
def test_no_python_workers(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "EvalPython" not in text and "InPandas" not in text and "CartesianProduct" not in text


def test_exact_sum_is_order_independent(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(1e9,)], "v double")
    assert df.agg(V.exact_sum(F.col("v"))).first()[0] == 1000000001.0
