import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.plans import quantiles
from tablelens.plans.quantiles import column_histograms, exact_quantiles_wide

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns():
    rng = np.random.default_rng(11)
    n = 4000
    return {"normal": rng.normal(size=n), "heavy": rng.lognormal(0, 6, n) * rng.choice([-1, 1], n), "ids": 1e9 + rng.permutation(n),
            "constant": np.full(n, 3.25), "two": rng.integers(0, 2, n) * 1.0, "tiny": rng.normal(size=n) * 5e-324 * 1000,
            "huge": rng.normal(size=n) * 1e300, "zeros": np.where(rng.random(n) < .9, 0.0, -rng.random(n)), "few": np.r_[[7.5, -0.0, 0.0], np.full(n - 3, np.nan)],
            "none": np.full(n, np.nan)}


@pytest.fixture(scope="module")
def table(spark):
    data = columns()
    rows = [[None if math.isnan(v) else float(v) for v in row] for row in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5), data


@pytest.mark.parametrize("cut", [False, True])
def test_quantiles_of_odd_columns(table, monkeypatch, cut):
    df, data = table
    if cut:  # every bracket is cut again until it is small
        monkeypatch.setattr(quantiles, "_BRACKET_ROWS", 3)
        monkeypatch.setattr(quantiles, "_LINEAR_BINS", 8)
    got = {r.variable: (r.n, r.q) for r in exact_quantiles_wide(df, {c: F.col(c) for c in data}, PROBS).collect()}
    for c, values in data.items():
        here = values[~np.isnan(values)]
        if len(here):
            assert got[c][0] == len(here)
            np.testing.assert_array_equal(got[c][1], np.quantile(here, PROBS), err_msg=c) if c in ("constant", "two", "ids") else \
                np.testing.assert_allclose(got[c][1], np.quantile(here, PROBS), rtol=1e-12, err_msg=c)
        else:
            assert c not in got


def test_bins_ascend_and_hold_every_value(table):
    df, data = table
    hist = column_histograms(df, {c: F.col(c) for c in data})
    for c, values in data.items():
        here, h = values[~np.isnan(values)], hist[c]
        assert h.n == len(here) == sum(k for *_, k in h.bins)
        assert all(a[1] < b[0] for a, b in zip(h.bins, h.bins[1:]))
        assert not len(here) or (h.bins[0][0], h.bins[-1][1]) == (here.min(), here.max())


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (float("-inf"),), (None,)], "x double")
    got = exact_quantiles_wide(df, {"x": F.col("x")}, [0.0, 0.5, 1.0]).first()
    assert got.n == 4 and got.q[1] == 1.5  # at the ends infinities are interpolated, which has no value
