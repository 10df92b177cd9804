"""Plan-shape checks: the properties the scale design relies on."""

from pyspark.sql import functions as F

from tablelens import fixtures as fx
from tablelens.operators import dedupe as G
from tablelens.operators import profile as P
from tablelens.operators import charts as H
from tablelens.operators.knn import knn_impute


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_dedupe_is_partial_aggregate_not_window(spark, sf001):
    ev = fx.table(spark, sf001, "events")
    p = plan(G.dedupe(ev, ["user_id", "event_type"], "first", ["event_id"]))
    assert "Window" not in p
    assert "partial_min" in p


def test_describe_pushes_projection_to_scan(spark, sf001):
    li = fx.table(spark, sf001, "lineitem")
    p = plan(P.describe_numeric(li, ["l_quantity"], exact=False))
    assert "ReadSchema: struct<l_quantity:double>" in p
    p = plan(P.describe_categorical(li, ["l_returnflag"]))
    assert "ReadSchema: struct<l_returnflag:string>" in p


def test_filters_reach_parquet(spark, sf001):
    li = fx.table(spark, sf001, "lineitem").where(F.col("l_returnflag") == "R")
    p = plan(H.value_counts(li, "l_linestatus"))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in p


def test_no_cartesian_products_anywhere(spark, sf001):
    li = fx.table(spark, sf001, "lineitem")
    frames = [H.kde(li, "l_extendedprice"), H.box_stats(li, "l_quantity"),
              H.distribution_summary(li, "l_tax"), H.normal_curve(li, "l_tax"),
              H.histogram(li, "l_quantity", 7)]
    for f in frames:
        p = plan(f)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_knn_plan_uses_group_limit_and_equi_join(spark, sf001):
    cm = fx.customer_missing(spark, sf001)
    out = knn_impute(cm, ["c_acctbal"], 5, ["c_acctbal", "c_nationkey", "c_custkey"], ["c_custkey"])
    p = plan(out)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert out.where(F.col("c_acctbal").isNull()).count() == 0


def test_grouped_parameters_do_not_shuffle_the_rows(spark, sf001):
    """Per-group fences, means and brackets are broadcast once counted: the only exchanges
    are those of aggregates, none moves data rows to a task by their (maybe hot) group."""
    c = fx.table(spark, sf001, "customer")
    for out in (H.grouped_box(c, "c_mktsegment", "c_acctbal"), H.strip_points(c, "c_mktsegment", "c_acctbal"),
                H.distribution_summary(c, "c_acctbal", by="c_mktsegment")):
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                scan = next(k for k in range(i, len(lines)) if "Scan" in lines[k])
                between = " ".join(lines[i:scan])
                assert "customer.parquet" not in lines[scan] or "Aggregate" in between, between
