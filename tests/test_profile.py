import math

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.operators import columns as C
from tablelens.operators import profile as P


def test_describe_numeric_golden(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 4, 4, 9, 9]], "x double")
    r = P.describe_numeric(df).collect()[0]
    assert (r["count"], r["q25"], r["q50"], r["q75"], r["min"], r["max"], r["missing"]) == (6, 2.5, 4.0, 7.75, 1.0, 9.0, 0)
    assert r["std"] == pytest.approx(pd.Series([1, 2, 4, 4, 9, 9]).std())


def test_describe_numeric_nan_and_null_are_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    r = P.describe_numeric(df).collect()[0]
    assert (r["count"], r["missing"], r["mean"]) == (2, 2, 2.0)


def test_describe_numeric_all_null_and_single_row(spark):
    df = spark.createDataFrame([(None, 5.0)], "a double, b double")
    out = {r["variable"]: r for r in P.describe_numeric(df).collect()}
    assert out["a"]["count"] == 0 and out["a"]["q50"] is None and out["a"]["missing"] == 1
    assert out["b"]["count"] == 1 and out["b"]["std"] is None and out["b"]["q25"] == 5.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_match_pandas(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    r = P.describe_numeric(df).collect()[0]
    s = pd.Series(values, dtype="float64")
    for col, q in (("q25", .25), ("q50", .5), ("q75", .75)):
        assert r[col] == pytest.approx(s.quantile(q), abs=1e-9)


def test_mode_tie_smallest_and_nulls_ignored(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "c string")
    r = P.mode_report(df).collect()[0]
    assert (r["mode"], r["freq"]) == ("a", 1)
    assert r["pct"] == pytest.approx(20.0)


def test_describe_categorical(spark):
    df = spark.createDataFrame([("x", True), ("y", False), ("x", None), (None, True)], "s string, b boolean")
    out = {r["variable"]: r for r in P.describe_categorical(df).collect()}
    assert (out["s"]["count"], out["s"]["unique"], out["s"]["top"], out["s"]["freq"], out["s"]["missing"]) == (3, 2, "x", 2, 1)
    assert out["b"]["top"] == "True"


def test_missing_report_sorted_and_rounded(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, float("nan"), None), (1, 2.0, "c")], "a long, b double, c string")
    rows = [(r["variable"], r["missing"], r["pct"]) for r in P.missing_report(df).collect()]
    assert rows == [("a", 2, 66.67), ("b", 1, 33.33), ("c", 1, 33.33)]


def test_duplicate_count_groups_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3), (2, 3), (2, 4)], "a long, b long")
    r = P.duplicate_count(df).collect()[0]
    assert (r["rows"], r["distinct_rows"], r["duplicates"]) == (5, 3, 2)


def test_round_floats_numpy_rule(spark):
    df = spark.createDataFrame([(1.015, 3.0), (2.675, 4.0), (2.5, 5.0)], "x double, w double")
    out = C.round_floats(df).collect()
    assert [r["x"] for r in out] == [1.01, 2.68, 2.5]
    assert [r["w"] for r in out] == [3.0, 4.0, 5.0]


def test_search_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "p_a long, P_B long, other long")
    assert C.search_columns(df, "^p_").columns == ["p_a", "P_B"]
    assert C.search_columns(df, "zzz").columns == []


def test_empty_frame_guards(spark):
    df = spark.createDataFrame([], "x double, c string")
    assert P.describe_numeric(df).collect()[0]["count"] == 0
    assert P.missing_report(df).count() == 0
    assert C.is_empty(df)


def test_to_numeric_and_group_label(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(C.to_numeric("s")).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] is None
    assert [r[0] for r in df.select(C.group_label("s")).collect()] == ["1.5", "abc", "None"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-5, 5)), min_size=1, max_size=80),
       st.sampled_from([10, 1000, 50_000]))
def test_refined_quantiles_equal_full_ranking(spark, pairs, accuracy):
    from tablelens.plans.quantiles import exact_quantiles_refined
    from tablelens.plans.ranks import exact_quantiles
    df = spark.createDataFrame([(g, float(v)) for g, v in pairs], "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    a = sorted(map(tuple, exact_quantiles_refined(df, "x", probs, ["g"], accuracy=accuracy).collect()))
    b = sorted(map(tuple, exact_quantiles(df, "x", probs, ["g"]).collect()))
    assert a == b
    s = pd.Series([float(v) for _, v in pairs])
    whole = exact_quantiles_refined(df, "x", probs, accuracy=accuracy).collect()[0]["q"]
    assert whole == pytest.approx([s.quantile(p) for p in probs], abs=1e-12)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=4, max_size=50))
def test_adjusted_moments_match_pandas(spark, values):
    from tablelens.operators.charts import distribution_summary
    s = pd.Series(values, dtype="float64")
    r = distribution_summary(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").collect()[0]
    if s.std() == 0:
        assert r["skewness"] is None and r["kurtosis"] is None
    else:
        assert r["skewness"] == pytest.approx(s.skew(), rel=1e-9, abs=1e-9)
        assert r["kurtosis"] == pytest.approx(s.kurt(), rel=1e-9, abs=1e-9)
    assert r["median"] == pytest.approx(s.median())


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 8), min_size=1, max_size=60))
def test_average_ranks_match_pandas(spark, values):
    from tablelens.plans.ranks import average_ranks, value_offsets
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ranks = {r["value"]: r["rank"] for r in average_ranks(value_offsets(df, "x", n_buckets=3)).collect()}
    s = pd.Series(values, dtype="float64")
    for v, rk in zip(s, s.rank(method="average")):
        assert ranks[v] == rk


def test_two_rows_edge_cases(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    r = P.describe_numeric(df).collect()[0]
    assert (r["q25"], r["q50"], r["q75"]) == (1.5, 2.0, 2.5)
    from tablelens.operators.charts import distribution_summary
    d = distribution_summary(df, "x").collect()[0]
    assert d["skewness"] is None and d["kurtosis"] is None


def test_select_positions_like_iloc(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    keys = rng.permutation(500) * 3 + 7
    pdf = pd.DataFrame({"k": keys, "v": rng.normal(size=500)})
    df = spark.createDataFrame(pdf)
    picks = [0, 5, 17, 499]
    got = C.select_positions(df, "k", picks).orderBy("k").toPandas()
    exp = pdf.sort_values("k").iloc[picks].reset_index(drop=True)
    pd.testing.assert_frame_equal(got.reset_index(drop=True), exp, check_dtype=False)


def test_page(spark):
    df = spark.createDataFrame([(i * 2, f"r{i}") for i in range(37)], "k long, s string")
    assert [r["k"] for r in C.page(df, 2, 10, "k").collect()] == list(range(40, 60, 2))
    assert [r["k"] for r in C.page(df, 3, 10, "k").collect()] == list(range(60, 74, 2))
    assert [r["s"] for r in C.page(df, 1, 5, "s").collect()] == sorted(f"r{i}" for i in range(37))[5:10]
