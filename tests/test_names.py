"""Every operator on columns whose names hold dots, spaces, back quotes, or are names an operator uses itself."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts, columns, convert, dedupe, htests, impute, profile, scale
from tablelens.operators.knn import knn_impute

NAMES = {"id": "row.id", "x": "Sepal.Length", "y": "a b", "c": "Cat.A", "g": "`q`.g", "n": "n", "d": "day.`s"}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 11) / 3, float(i * i % 17), "uv.w"[i % 4], "pq"[i % 2], i % 5, dt.datetime(2024, 1, 1 + i % 9)) for i in range(80)]
    plain = spark.createDataFrame(rows, "id long, x double, y double, c string, g string, n int, d timestamp")
    return plain, plain.toDF(*[NAMES[c] for c in plain.columns])


CALLS = {
    "shapiro": lambda t, o: htests.shapiro(t, o("x")), "shapiro_by": lambda t, o: htests.shapiro(t, o("x"), by=o("g")),
    "ks": lambda t, o: htests.ks_normal(t, o("x")), "ks_by": lambda t, o: htests.ks_normal(t, o("x"), by=o("g")),
    "ks_statistic": lambda t, o: htests.ks_statistic(t, o("x"), o("g")),
    "pearson": lambda t, o: htests.pearson(t, o("x"), o("y")), "pearson_by": lambda t, o: htests.pearson(t, o("x"), o("n"), by=o("g"), listwise="used"),
    "spearman": lambda t, o: htests.spearman(t, o("x"), o("y")), "spearman_by": lambda t, o: htests.spearman(t, o("n"), o("y"), by=o("c")),
    "chi2": lambda t, o: htests.chi2(t, o("c"), o("g")), "chi2_by": lambda t, o: htests.chi2(t, o("c"), o("n"), by=o("g")),
    "contingency": lambda t, o: htests.contingency(t, o("c"), o("g"), by=o("n")), "contingency_wide": lambda t, o: htests.contingency_wide(t, o("g"), o("c")),
    "t_test": lambda t, o: htests.t_test(t, o("g"), o("x")), "welch": lambda t, o: htests.t_test(t, o("g"), o("y"), by=o("n"), equal_var=False, order_key=o("id")),
    "box": lambda t, o: charts.box_stats(t, o("x")), "box_by": lambda t, o: charts.box_stats(t, o("x"), by=o("c")),
    "outliers": lambda t, o: charts.box_outliers(t, o("y")), "grouped_box": lambda t, o: charts.grouped_box(t, o("c"), o("x")),
    "summary": lambda t, o: charts.distribution_summary(t, o("n"), by=o("g")), "summary_all": lambda t, o: charts.distribution_summary(t, o("x")),
    "histogram": lambda t, o: charts.histogram(t, o("x")), "kde": lambda t, o: charts.kde(t, o("x"), 5), "curve": lambda t, o: charts.normal_curve(t, o("x"), 5),
    "qq": lambda t, o: charts.qq_points(t, o("x")), "counts": lambda t, o: charts.value_counts(t, o("c"), o("g")), "shares": lambda t, o: charts.value_shares(t, o("c")),
    "strip": lambda t, o: charts.strip_points(t, o("c"), o("x"), 9, row_key=[o("id")]), "scatter": lambda t, o: charts.scatter_points(t, [o("x"), o("n")], 9, row_key=[o("id")]),
    "correlation": lambda t, o: charts.correlation_matrix(t, [o("x"), o("y"), o("n")]), "correlation_pairs": lambda t, o: charts.correlation_matrix(t, [o("x"), o("y")], listwise=False),
    "grouped_mean": lambda t, o: charts.grouped_mean(t, o("c"), o("x")),
    "describe": lambda t, o: profile.describe_numeric(t), "describe_text": lambda t, o: profile.describe_categorical(t), "missing": lambda t, o: profile.missing_report(t),
    "modes": lambda t, o: profile.mode_report(t), "duplicates": lambda t, o: profile.duplicate_count(t, [o("c"), o("g")]),
    "preview": lambda t, o: columns.preview(t, 4, o("id")), "page": lambda t, o: columns.page(t, 2, 5, o("id")), "positions": lambda t, o: columns.select_positions(t, o("id"), [1, 70]),
    "select_rows": lambda t, o: columns.select_rows(t, o("id"), [3, 4]), "drop": lambda t, o: columns.drop_missing(t, [o("x")]), "round": lambda t, o: columns.round_floats(t),
    "sample": lambda t, o: columns.sample_rows(t, 7, row_key=[o("id")]), "share": lambda t, o: columns.value_share(t, o("c"), "u"),
    "impute": lambda t, o: impute.impute(t, mean=[o("x")], mode=[o("c")]), "median": lambda t, o: impute.impute(t, median=[o("x")]),
    "knn": lambda t, o: knn_impute(t, [o("x")], 3, [o("x"), o("y"), o("n")], [o("id")]),
    "impute_preview": lambda t, o: impute.impute_preview(t, impute.fit_imputer(t, mean=[o("x")]), [o("id")]),
    "impute_report": lambda t, o: impute.impute_report(t, impute.fit_imputer(t, knn=[o("x")], knn_features=[o("x"), o("y")], knn_order=[o("id")])),
    "convert": lambda t, o: convert.convert(t, {o("n"): "float64"})[0], "convert_preview": lambda t, o: convert.convert_preview(t, {o("n"): "object"}, 3, [o("id")]),
    "dedupe": lambda t, o: dedupe.dedupe(t, [o("c"), o("g")], order_by=[o("id")]), "dedupe_none": lambda t, o: dedupe.dedupe(t, [o("c")], keep=False),
    "dedupe_report": lambda t, o: dedupe.dedupe_report(t, [o("c")]), "normalize": lambda t, o: scale.normalize(t, o("x"), "robust"),
    "normalize_report": lambda t, o: scale.normalize_report(t, o("x")), "normalize_preview": lambda t, o: scale.normalize_preview_hist(t, o("x")),
}


def rows(df):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("call", sorted(CALLS))
def test_names_change_nothing_else(tables, call):
    plain, odd = tables
    want, got = CALLS[call](plain, lambda c: c), CALLS[call](odd, NAMES.get)
    back = {v: k for k, v in NAMES.items()}
    unnamed = [tuple(back.get(v, v) for v in r) for r in rows(got)]
    assert len(got.columns) == len(want.columns)
    assert sorted(unnamed, key=str) == sorted((tuple(back.get(v, v) for v in r) for r in rows(want)), key=str)
    assert [back.get(c, c).replace(NAMES["x"], "x") for c in got.columns] == want.columns


def test_unknown_and_differently_cased_names(tables):
    plain, _ = tables
    assert htests.pearson(plain, "X", "Y").columns == htests.pearson(plain, "x", "y").columns
    with pytest.raises(ValueError, match="no column"):
        htests.pearson(plain, "x", "nowhere")


def test_listwise_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(50).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"), F.lit("z").alias("other")).write.parquet(path)
    plan = htests.pearson(spark.read.parquet(path), "x", "y", listwise="used")._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(x)" in plan and "other" not in plan.split("ReadSchema")[1][:60]
