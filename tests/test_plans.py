"""The plans that the queries are meant to have."""

from __future__ import annotations

import pytest

from granary.plans import registry
from granary.plans.explain import explain, physical
from tests.conftest import DATA

FOLDER = str(DATA / "sf0.01")
DEFINITIONS = registry.definitions()


def plan(spark, key):
    return DEFINITIONS[key].run(spark, FOLDER)


@pytest.mark.parametrize("key,pushed", [("point_lookup", "EqualTo(o_orderkey,42)"), ("filter_between", "GreaterThanOrEqual(l_discount,0.02)"), ("filter_in", "In(o_orderstatus, [F,O])"), ("tpch_q6_shape", "LessThan(l_quantity,24.0)"), ("join_extra_on", "GreaterThan(o_totalprice,300000.0)")])
def test_filters_reach_the_scan(spark, key, pushed):
    assert any(pushed in f for f in explain(plan(spark, key)).pushed_filters)


@pytest.mark.parametrize("key,columns", [("scan_project", {"o_orderkey", "o_orderstatus"}), ("group_expr", {"o_custkey", "o_orderkey"}), ("topk", {"o_orderkey", "o_totalprice"}), ("distinct_multi", {"o_orderstatus", "o_orderpriority"})])
def test_scans_read_only_what_is_used(spark, key, columns):
    (read,) = explain(plan(spark, key)).read_columns
    assert {c.split(":")[0] for c in read.split(",")} == columns


@pytest.mark.parametrize("key", ["topk", "topk_ties", "limit_no_order", "offset_page", "group_topk", "setop_ordered"])
def test_limits_never_sort_everything(spark, key):
    text = physical(plan(spark, key))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("key,most", [("tpch_q1_shape", 1), ("agg_multi", 1), ("agg_count_distinct", 2), ("win_row_number", 1), ("project_expr", 0), ("win_sum_total", 1), ("ext_tumbling", 1), ("distinct_agg", 1)])
def test_shuffles_are_as_few_as_needed(spark, key, most):
    assert explain(plan(spark, key)).shuffles <= most


def test_only_cross_and_theta_joins_are_heavy(spark):
    meant = {"join_cross", "join_theta", "in_empty", "win_sum_total", "anti_not_in_null", "anti_not_in", "win_row_number_global"}  # the last sums one count a partition
    for key in DEFINITIONS:
        if key.startswith(("join_", "semi_", "anti_", "win_", "group_", "subq_", "except", "intersect")) and key not in meant:
            assert not explain(plan(spark, key)).heavy, key


def test_python_only_in_routing(spark):
    for key in DEFINITIONS:
        if not key.startswith(("route_", "rebucket", "win_row_number_global", "dml_", "cdc_", "placement_")):
            assert not explain(plan(spark, key)).python, key
