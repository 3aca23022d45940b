"""Plans stay as they were meant: filters and columns reach the scan, joins need no nested loops, top-k needs no full sort."""

import re

import pytest

from lodewright.plans import catalog


def plan(spark, sf, name):
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(spark, sf, "scan_time_range")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in p
    assert "In(o_orderkey" in plan(spark, sf, "scan_pk_lookup")
    p = plan(spark, sf, "tpch_pricing_summary")
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_returnflag:string" in p and "LessThanOrEqual(l_shipdate" in p


def test_contradiction_reads_nothing(spark, sf):
    assert "FileScan" not in plan(spark, sf, "filter_contradiction")


@pytest.mark.parametrize("name", ["scan_ordered_topk", "sort_top_expression", "fts_top_k", "vector_cosine", "spatial_nearest"])
def test_top_k_is_bounded(spark, sf, name):
    assert "TakeOrderedAndProject" in plan(spark, sf, name)


@pytest.mark.parametrize("name", ["filter_exists", "filter_not_exists", "filter_not_in_subquery", "join_four_tables", "join_left", "range_overlap_join", "spatial_dwithin_join", "join_as_of", "geofence_transitions", "write_upsert", "fts_bm25"])
def test_no_pairs_of_everything(spark, sf, name):
    p = plan(spark, sf, name)
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_as_of_join_shuffles_once(spark, sf):
    assert plan(spark, sf, "join_as_of").count("Exchange hashpartitioning") == 1


def test_top_per_group_is_cut_before_the_shuffle(spark, sf):
    p = plan(spark, sf, "sort_top_per_group")
    assert p.count("WindowGroupLimit") == 2 and p.rindex("WindowGroupLimit") > p.index("Exchange")


def test_bucketed_join_needs_no_exchange(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(spark, sf, "join_bucketed")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["cube_relation", "fts_boolean", "fts_bm25", "vector_cosine", "temporal_as_of", "join_as_of", "fn_ranges", "fn_planar", "spatial_dwithin_join", "geofence_transitions", "live_changes"])
def test_no_python_where_expressions_do(spark, sf, name):
    assert not re.search("Python|Pandas|InArrow", plan(spark, sf, name))
