import math

import numpy as np
import pandas as pd
import pytest

from tablelens.operators import dedupe as G
from tablelens.operators import impute as I
from tablelens.operators import scale as S
from tablelens.operators.knn import knn_impute


def test_impute_methods(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 4.0), (2, None, None, None), (3, 5.0, "b", 8.0), (4, 3.0, "b", None)],
                               "id long, x double, c string, z double")
    out = I.impute(df, mean=["x"], mode=["c"], zero=["z"]).orderBy("id").collect()
    assert [r["x"] for r in out] == [1.0, 3.0, 5.0, 3.0]
    assert [r["c"] for r in out] == ["a", "b", "b", "b"]
    assert [r["z"] for r in out] == [4.0, 0.0, 8.0, 0.0]
    med = I.impute(df, median=["z"]).orderBy("id").collect()
    assert [r["z"] for r in med] == [4.0, 6.0, 8.0, 6.0]


def test_plan_validation(spark):
    df = spark.createDataFrame([(None, None)], "x double, c string")
    with pytest.raises(I.ImputePlanError):
        I.validate_plan(df, mean=["x"], zero=["x"])
    with pytest.raises(I.ImputePlanError):
        I.validate_plan(df, mean=["c"])
    assert I.validate_plan(df, mean=["x"])["untreated"] == ["c"]
    with pytest.raises(I.ImputePlanError):
        I.validate_plan(df, strict=True, mean=["x"])


def test_impute_report_and_preview(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i)) for i in range(10)], "id long, x double")
    model = I.fit_imputer(df, mean=["x"])
    rep = I.impute_report(df, model).collect()[0]
    assert (rep["missing_before"], rep["missing_after"], rep["success_pct"]) == (4, 0, 100.0)
    prev = I.impute_preview(df, model, ["id"], 3).collect()
    assert [r["id"] for r in prev] == [0, 3, 6]


def _brute_knn(X, target, k):
    """numpy twin of nan-euclidean KNN fill with (distance, row) tie-break."""
    n, f = X.shape
    out = X[:, target].copy()
    donors = np.where(~np.isnan(X[:, target]))[0]
    for r in np.where(np.isnan(X[:, target]))[0]:
        cand = []
        for d in donors:
            both = ~np.isnan(X[r]) & ~np.isnan(X[d])
            if both.sum() == 0:
                continue
            dist = math.sqrt(f / both.sum() * float(np.sum((X[r, both] - X[d, both]) ** 2)))
            cand.append((dist, d))
        cand.sort()
        out[r] = np.mean([X[d, target] for _, d in cand[:k]]) if cand else np.nanmean(X[:, target])
    return out


@pytest.mark.parametrize("seed,all_incomplete", [(1, False), (2, False), (3, True), (4, True)])
def test_knn_matches_brute_force(spark, seed, all_incomplete):
    rng = np.random.default_rng(seed)
    n = 300
    X = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.normal(size=n) * 10,
                         rng.normal(size=n)])
    X[rng.random(n) < 0.2, 0] = np.nan      # target
    X[rng.random(n) < 0.2, 3] = np.nan      # another incomplete feature
    X[:40, 1] = 2.0                         # a hot value / duplicate vectors
    X[:40, 2] = 1.0
    if all_incomplete:                      # no feature is complete besides none
        X[rng.random(n) < 0.15, 1] = np.nan
        X[rng.random(n) < 0.1, 2] = np.nan
        X[5, 1:] = np.nan                   # a row with no feature at all
    pdf = pd.DataFrame(X, columns=["t", "a", "b", "c"]).assign(id=np.arange(n))
    df = spark.createDataFrame(pdf)
    for k in (1, 5):
        got = (knn_impute(df, ["t"], k=k, features=["t", "a", "b", "c"], order_by=["id"])
               .orderBy("id").toPandas()["t"].to_numpy())
        exp = _brute_knn(X, 0, k)
        np.testing.assert_allclose(got, exp, rtol=1e-12, atol=1e-12)


def test_knn_single_feature_is_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id long, x double")
    out = knn_impute(df, ["x"], k=5, order_by=["id"]).orderBy("id").collect()
    assert out[1]["x"] == 2.0


def test_scalers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    std = [r["x_norm"] for r in S.normalize(df, "x", "standard").orderBy("x").collect()]
    assert std[0] == pytest.approx(-1.5666989036012806)
    rob = [r["x_norm"] for r in S.normalize(df, "x", "robust").orderBy("x").collect()]
    assert rob[0] == pytest.approx(-1.0)
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert {r["x_norm"] for r in S.normalize(const, "x", "minmax").collect()} == {0.0}
    assert {r["x_norm"] for r in S.normalize(const, "x", "standard").collect()} == {0.0}
    logs = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (math.e - 1,)], "x double")
    vals = [r["x_norm"] for r in S.normalize(logs, "x", "log").orderBy("x").collect()]
    assert vals[0] is None and vals[1] is None and vals[2] == 0.0 and vals[3] == pytest.approx(1.0)


def test_dedupe_keep_variants(spark):
    rows = [(i, "hot" if i < 50 else f"k{i % 7}", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, key string, v double")
    pdf = pd.DataFrame(rows, columns=["id", "key", "v"])
    first = G.dedupe(df, ["key"], "first", ["id"]).orderBy("id").toPandas()
    exp = pdf.sort_values("id").drop_duplicates("key", keep="first").sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(first, exp, check_dtype=False)
    last = G.dedupe(df, ["key"], "last", ["id"]).orderBy("id").toPandas()
    exp = pdf.sort_values("id").drop_duplicates("key", keep="last").sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(last, exp, check_dtype=False)
    none = G.dedupe(df.union(spark.createDataFrame([(999, "solo", 1.0)], df.schema)), ["key"], keep=False)
    assert [r["key"] for r in none.collect()] == ["solo"]
    rep = G.dedupe_report(df, ["key"]).collect()[0]
    assert (rep["initial"], rep["remaining"], rep["removed"]) == (100, 8, 92)


def test_complete_columns_are_left_untouched(spark):
    df = spark.createDataFrame([(1, 2, None), (2, 4, 3.0)], "id long, full long, gap double")
    out = I.impute(df, mean=["full", "gap"])
    assert dict(out.dtypes)["full"] == "bigint"
    assert [r["gap"] for r in out.orderBy("id").collect()] == [3.0, 3.0]
    model = I.fit_imputer(df, mean=["full", "gap"])
    rep = {r["variable"]: r for r in I.impute_report(df, model, with_total=True).collect()}
    assert rep["TOTAL"]["missing_before"] == 1 and rep["TOTAL"]["success_pct"] == 100.0
    assert rep["full"]["success_pct"] is None
