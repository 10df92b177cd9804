import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from tablelens.operators import charts as H
from tablelens.operators import htests as T

SW20 = [.11, 7.87, 4.61, 10.14, 7.95, 3.14, .46, 4.43, .21, 4.75, .71, 1.52, 3.24, .93, .42, 4.97, 9.53, 4.55, .47, 6.66]
SW11 = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def _x(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_histogram_bins_and_closed_last(spark):
    df = _x(spark, [0, 1, 2, 3, 10])
    out = H.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in out] == [2, 2, 0, 0, 1]
    assert out[-1]["upper"] == 10.0 and out[0]["lower"] == 0.0
    dens = H.density_histogram(df, "x", 5).collect()
    assert sum(r["density"] * 2.0 for r in dens) == pytest.approx(1.0)


def test_histogram_constant_column(spark):
    out = H.histogram(_x(spark, [3, 3, 3]), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in out] == [3, 0, 0, 0]


def test_box_stats(spark):
    out = H.box_stats(_x(spark, [1, 2, 3, 4, 100]), "x").collect()[0]
    assert (out["q1"], out["median"], out["q3"]) == (2.0, 3.0, 4.0)
    assert (out["whisker_low"], out["whisker_high"], out["outliers"]) == (1.0, 4.0, 1)
    assert [r["value"] for r in H.box_outliers(_x(spark, [1, 2, 3, 4, 100]), "x").collect()] == [100.0]


def test_distribution_summary_adjusted(spark):
    r = H.distribution_summary(_x(spark, [1, 2, 4, 4, 9, 9]), "x").collect()[0]
    assert r["skewness"] == pytest.approx(0.47899, abs=1e-5)
    assert r["kurtosis"] == pytest.approx(-1.77989, abs=1e-5)
    s = pd.Series([1, 2, 4, 4, 9, 9], dtype=float)
    assert r["skewness"] == pytest.approx(s.skew()) and r["kurtosis"] == pytest.approx(s.kurt())


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=400), 2)
    out = H.kde(_x(spark, v), "x").orderBy("i").toPandas()
    h = v.std(ddof=1) * len(v) ** (-0.2)
    grid = np.linspace(v.min(), v.max(), 100)
    exp = np.exp(-((grid[:, None] - v[None, :]) ** 2) / (2 * h * h)).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(out["x"], grid, rtol=1e-12)
    np.testing.assert_allclose(out["density"], exp, rtol=1e-10)


def test_qq_points(spark):
    v = [5.0, 1.0, 3.0, 3.0]
    out = H.qq_points(_x(spark, v), "x").orderBy("pos").collect()
    ps = np.linspace(0.01, 0.99, 4)
    assert [r["observed"] for r in out] == sorted(v)
    for r, p in zip(out, ps):
        assert r["theoretical"] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-13)


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, k double")
    out = {(r["var_x"], r["var_y"]): r["r"] for r in H.correlation_matrix(df, ["a", "b", "k"]).collect()}
    assert out[("a", "a")] == 1.0 and out[("k", "k")] is None and out[("a", "k")] is None
    assert out[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])


def test_grouped_mean_and_box(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "3"), (None, "2"), ("b", "x")], "g string, v string")
    gm = {r["group"]: (r["mean"], r["count"]) for r in H.grouped_mean(df, "g", "v").collect()}
    assert gm == {"a": (2.0, 2), "None": (2.0, 1)}
    gb = {r["group"]: r["median"] for r in H.grouped_box(df, "g", "v").collect()}
    assert gb == {"a": 2.0, "None": 2.0}


def test_shapiro_goldens(spark):
    r = T.shapiro(_x(spark, SW20), "x").collect()[0]
    assert (r["w"], r["p_value"]) == (pytest.approx(0.900473, abs=1e-6), pytest.approx(0.042090, abs=1e-6))
    r = T.shapiro(_x(spark, SW11), "x").collect()[0]
    assert (r["w"], r["p_value"]) == (pytest.approx(0.788815, abs=1e-6), pytest.approx(0.006704, abs=1e-6))
    assert r["verdict"] == "not normal"


def test_shapiro_heavy_ties_chunked(spark):
    from tablelens.plans.ranks import sorted_positions, value_offsets
    df = _x(spark, [1.0] * 2500 + [2.0] * 10 + [3.0])
    pos = sorted_positions(value_offsets(df, "x"), chunk=100)
    got = pos.orderBy("pos").toPandas()
    assert got["pos"].tolist() == list(range(1, 2512))
    assert got["value"].tolist() == [1.0] * 2500 + [2.0] * 10 + [3.0]


def test_ks_statistic_matches_definition(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.exponential(size=300), 1)
    r = T.ks_normal(_x(spark, v), "x").collect()[0]
    z = np.sort((v - v.mean()) / v.std(ddof=1))
    cdf = np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in z])
    n = len(z)
    d = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(0, n) / n).max())
    assert r["statistic"] == pytest.approx(d, abs=1e-12)
    assert 0 <= r["p_value"] < 0.05


def test_chi2_goldens_and_zero_cells(spark):
    rows = [("a1", "b1")] * 10 + [("a1", "b2")] * 20 + [("a2", "b1")] * 30 + [("a2", "b2")] * 15
    df = spark.createDataFrame(rows, "a string, b string")
    assert T.chi2(df, "a", "b").collect()[0]["chi2"] == pytest.approx(6.7522, abs=1e-4)
    assert T.chi2(df, "a", "b", yates=False).collect()[0]["chi2"] == pytest.approx(8.0357, abs=1e-4)
    # 3x3 with empty cells: compare with the full-table formula
    rows = [("x", "p")] * 5 + [("x", "q")] * 3 + [("y", "q")] * 4 + [("z", "r")] * 6 + [("y", "r")] * 1
    df = spark.createDataFrame(rows, "a string, b string")
    obs = pd.crosstab(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])).to_numpy().astype(float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    r = T.chi2(df, "a", "b").collect()[0]
    assert r["chi2"] == pytest.approx(((obs - exp) ** 2 / exp).sum(), rel=1e-12) and r["dof"] == 4


def test_t_tests(spark):
    rows = [("g1", 1.0), ("g1", 2.0), ("g1", 3.0), ("g2", 4.0), ("g2", 6.0), ("g2", 9.0)]
    df = spark.createDataFrame(rows, "c string, v double")
    r = T.t_test(df, "c", "v").collect()[0]
    assert r["t_stat"] == pytest.approx(-2.7716093126229353) and r["dof"] == 4
    assert r["p_value"] == pytest.approx(0.050248, abs=1e-6)
    w = T.t_test(df, "c", "v", equal_var=False).collect()[0]
    assert w["dof"] == pytest.approx(2.6162162162) and w["p_value"] == pytest.approx(0.0810716, abs=1e-6)
    three = spark.createDataFrame(rows + [("g3", 1.0)], "c string, v double")
    assert T.t_test(three, "c", "v").collect()[0]["status"] == "needs exactly 2 groups"


def test_pearson_spearman_vs_pandas(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 10, 200).astype(float)
    y = x * 2 + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    p = T.pearson(df, "x", "y").collect()[0]
    s = T.spearman(df, "x", "y").collect()[0]
    pdf = pd.DataFrame({"x": x, "y": y})
    assert p["r"] == pytest.approx(pdf.x.corr(pdf.y), rel=1e-12)
    assert s["r"] == pytest.approx(pdf.x.rank().corr(pdf.y.rank()), rel=1e-12)
    assert p["p_value"] < 1e-10 and p["verdict"] == "significant"


def test_t_test_first_appearance_order(spark):
    rows = [(1, "zz", 1.0), (2, "aa", 4.0), (3, "zz", 2.0), (4, "aa", 6.0), (5, "zz", 3.0), (6, "aa", 9.0)]
    df = spark.createDataFrame(rows, "id long, c string, v double")
    by_label = T.t_test(df, "c", "v").collect()[0]
    by_first = T.t_test(df, "c", "v", order_key="id").collect()[0]
    assert by_label["group_1"] == "aa" and by_first["group_1"] == "zz"
    assert by_first["t_stat"] == pytest.approx(-by_label["t_stat"])


def test_skewed_hot_value_quantiles(spark):
    # one value holds a third of the rows: results stay exact
    vals = [7.0] * 300 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(v, "hot" if i % 3 == 0 else "cold") for i, v in enumerate(vals)], "x double, g string")
    s = pd.Series(vals)
    r = H.box_stats(df, "x").collect()[0]
    assert (r["q1"], r["median"], r["q3"]) == (s.quantile(.25), s.quantile(.5), s.quantile(.75))
    grouped = {row["g"]: row["median"] for row in H.box_stats(df, "x", by="g").collect()}
    pdf = pd.DataFrame({"x": vals, "g": ["hot" if i % 3 == 0 else "cold" for i in range(len(vals))]})
    assert grouped == pdf.groupby("g")["x"].median().to_dict()


def test_value_counts_drop_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,), (2.0,)], "x double")
    assert [(r["x"], r["count"]) for r in H.value_counts(df, "x").collect()] == [(1.0, 2), (2.0, 1)]
    shares = {r["x"]: r["pct"] for r in H.value_shares(df, "x").collect()}
    assert shares[1.0] == pytest.approx(200 / 3)


def test_kde_of_odd_distributions(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    for values in (rng.normal(size=3000), np.r_[rng.normal(size=500), 1e7, -3e6], np.repeat([1.0, 2.0, 5.5], [400, 1, 30]), rng.lognormal(0, 3, 2000), [0.0, 1.0]):
        v = np.asarray(values, float)
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double")
        h = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min(), v.max(), 100)
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        got = [r["density"] for r in H.kde(df, "x").orderBy("i").collect()]
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-13 / h)


@pytest.mark.parametrize("small", [True, False])
def test_ranks_by_either_way(spark, monkeypatch, small):
    import numpy as np
    import pandas as pd

    from tablelens.plans import ranks
    if not small:
        monkeypatch.setattr(ranks, "BROADCAST_KEYS", 1)
        monkeypatch.setattr(ranks, "_INDEX_VALUES", 40)
        monkeypatch.setattr(ranks, "_RANGE_ROWS", 30)  # hot ranges are dealt to several tasks
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 900), "x": np.where(rng.random(900) < .4, 5.0, rng.normal(size=900) * 9), "y": rng.integers(0, 9, 900) * 1.0})
    frame.loc[:3, "x"] = [-0.0, 0.0, 1e300, -1e300]
    got = ranks.with_ranks(spark.createDataFrame(frame), ["x", "y"], ["g"]).toPandas()
    want = frame.groupby("g")[["x", "y"]].rank()
    for g in (0, 1):
        mine = sorted(map(tuple, got[got["g"] == g][["_r0", "_r1"]].to_numpy()))
        assert mine == sorted(map(tuple, want[frame["g"] == g].to_numpy()))
    assert ranks.with_ranks(spark.createDataFrame(frame.head(0), "g long, x double, y double"), ["x", "y"], ["g"]).count() == 0
