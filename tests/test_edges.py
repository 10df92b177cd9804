"""Inputs that the driver's clean tables don't reach."""

import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts as ch
from tablelens.operators import columns as cols
from tablelens.operators import htests as ht
from tablelens.operators import scale as sc
from tablelens.operators.convert import convert
from tablelens.operators.impute import ImputePlanError, fit_imputer, impute, impute_preview
from tablelens.operators.profile import mode_report
from tablelens.plans.fit import parse_double, parse_long
from tablelens.sources.delimited import RaggedRows, read_csv
from tablelens.sources.export import export_csv
from test_sources import _xlsx


def _write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_numbers_are_what_pandas_parses(spark):
    texts = ["10D", "20F", "1e5", ".5", "5.", " 7 ", "-inf", "1_0", "0x10", "", None, "1,2"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [tuple(r) for r in df.select(parse_double(F.col("s")), parse_long(F.col("s"))).collect()]
    assert [d for d, _ in got] == [None, None, 1e5, .5, 5.0, 7.0, -math.inf, None, None, None, None, None]
    assert [n for _, n in got] == [None] * 5 + [7] + [None] * 6
    assert [r[0] for r in df.select(cols.to_numeric("s")).collect()][:2] == [None, None]


def test_csv_quotes_line_breaks_and_names(spark, tmp_path):
    path = _write(tmp_path, "a.csv", 'Sepal.Length,note,code\n1.5,"hello\nworld",10D\n,"say ""hi"", ok",20F\n3,,NA\n')
    df = read_csv(spark, path)
    assert df.dtypes == [("Sepal.Length", "double"), ("note", "string"), ("code", "string")]
    assert [tuple(r) for r in df.collect()] == [(1.5, "hello\nworld", "10D"), (None, 'say "hi", ok', "20F"), (3.0, None, None)]
    assert [r["variable"] for r in cols.column_roles(df, counts=True).collect()] == ["Sepal.Length", "note", "code"]


def test_csv_rejects_ragged_rows_and_mixed_headers(spark, tmp_path):
    with pytest.raises(RaggedRows):
        read_csv(spark, _write(tmp_path, "long.csv", "a,b\n1,2\n1,2,3\n"))
    short = read_csv(spark, _write(tmp_path, "short.csv", "a,b\n1,2\n5\n"))
    assert sorted(map(tuple, short.collect())) == [(1, 2.0), (5, None)]
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    _write(folder, "p1.csv", "a,b\n1,x\n")
    _write(folder, "p2.csv", "b,a\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(folder)).collect()


def test_export_keeps_text(spark, tmp_path):
    rows = [("  pad ", 1.25), ('a "quoted", b', 2.5), ("two\nlines", None), (None, 3.0)]
    path = export_csv(spark.createDataFrame(rows, "t string, v double"), str(tmp_path), "kept_text")
    assert sorted((tuple(r) for r in read_csv(spark, path).collect()), key=repr) == sorted(rows, key=repr)


def test_samples_are_exact_and_see_equal_rows(spark):
    same = spark.range(3000).select(F.lit(1.0).alias("x"), F.col("id").alias("key"))
    assert cols.sample_rows(same.select("x"), 100).count() == 100
    assert cols.sample_rows(same, 5000).count() == 3000
    a, b = (sorted(r.key for r in cols.sample_rows(same, 50, seed, ["key"]).collect()) for seed in (1, 2))
    assert a != b and a == sorted(r.key for r in cols.sample_rows(same.repartition(7), 50, 1, ["key"]).collect())
    df = spark.range(2000).select(F.lit("g").alias("g"), F.lit(2.0).alias("v"))
    assert ch.strip_points(df, "g", "v", max_points=1).count() == 1
    assert ch.scatter_points(df, ["v"], max_points=1).count() == 1


def test_pages_and_positions_of_any_key(spark):
    big = 1 << 53
    rows = [(big, 1), (big + 1, 2), (None, 3), (None, 4), (big + 1, 5), (7, 6)]
    df = spark.createDataFrame(rows, "k long, v int").repartition(4)
    order = [(None, 3), (None, 4), (7, 6), (big, 1), (big + 1, 2), (big + 1, 5)]
    assert [tuple(r) for r in cols.page(df, 0, 4, "k").collect()] == order[:4]
    assert [tuple(r) for r in cols.page(df, 1, 4, "k").collect()] == order[4:]
    assert [tuple(r) for r in cols.page(df, 0, 2_000_000, "k").collect()] == order
    placed = {r._pos: (r.k, r.v) for r in cols.with_positions(df, "k").collect()}
    assert [placed[i] for i in range(6)] == order
    assert sorted((r.v for r in cols.select_positions(df, "k", [1, 5, 99]).collect())) == [4, 5]
    text = spark.createDataFrame([("b",), (None,), ("a",), ("a",)], "t string")
    assert [r.t for r in cols.page(text, 0, 3, "t").collect()] == [None, "a", "a"]


def test_guards_of_empty_and_all_null(spark):
    for df in (spark.createDataFrame([], "g string, x double"), spark.createDataFrame([("a", None), ("b", None)], "g string, x double")):
        assert ch.box_stats(df, "x").collect() == [] and ch.box_outliers(df, "x").collect() == []
        assert ch.grouped_box(df, "g", "x").collect() == []
        assert sc.normalize(df, "x", "robust").count() == df.count()
        assert ch.kde(df, "x").collect() == [] and ch.histogram(df, "x").collect() == []


def test_correlation_of_many_columns(spark):
    n = 40
    df = spark.range(200).select(*[(F.sin(F.col("id") * (i + 1)) + (F.lit(0.0) if i else F.lit(0.0))).alias(f"c.{i}") for i in range(n)],
                                 F.lit(3.0).alias("flat"))
    got = {(r.var_x, r.var_y): r.r for r in ch.correlation_matrix(df, df.columns).collect()}
    assert len(got) == (n + 1) ** 2 and got["flat", "flat"] is None and got["c.0", "flat"] is None and got["c.3", "c.3"] == 1.0
    pdf = df.toPandas()
    assert got["c.0", "c.7"] == pytest.approx(pdf["c.0"].corr(pdf["c.7"]), abs=1e-9)


def test_knn_takes_nan_as_missing(spark):
    nan = float("nan")
    rows = [(1, 1.0, 10.0), (2, 1.1, 20.0), (3, 5.0, 90.0), (4, 1.0, nan), (5, nan, 30.0), (6, 1.05, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = {r.id: r.b for r in impute(df, knn=["b"], k=2, knn_features=["a", "b"], knn_order=["id"]).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 90.0, 4: 15.0, 5: 30.0, 6: 15.0}
    with pytest.raises(ImputePlanError):
        impute(df.select("id", "a", F.lit(None).cast("double").alias("b")), knn=["b"], knn_features=["a", "b"], knn_order=["id"]).collect()


def test_impute_order_preview_and_numeric_mode(spark):
    rows = [(1, 9, 1.0, None), (2, 9, None, 5.0), (3, 10, 3.0, 6.0), (4, 10, 4.0, 7.0), (5, None, 5.0, 8.0)]
    df = spark.createDataFrame(rows, "id int, m int, z double, k double")
    model = fit_imputer(df, zero=["z"], mode=["m"], knn=["k"], k=1, knn_features=["z", "k"], knn_order=["id"])
    out = {r.id: r for r in model.transform(df).collect()}
    assert out[5].m == 9 and out[2].z == 0.0 and out[1].k == 6.0  # not the zero-filled row's 5.0
    seen = {(r.variable, r.id): r.after_value for r in impute_preview(df, model, ["id"]).collect()}
    assert seen == {("z", 2): 0.0, ("m", 5): 9.0, ("k", 1): 6.0}
    assert mode_report(df, ["m"]).first()["mode"] == "9"


def test_datetime_formats(spark):
    rows = [("2024-01-02 10:00:00.123", "02/03/2024", "02/03/2024"), ("2024-01-02T10:00:00Z", "13/03/2024", "03/04/2024")]
    out, _ = convert(spark.createDataFrame(rows, "iso string, day string, month string"), {"iso": "datetime", "day": "datetime", "month": "datetime"})
    got = out.select(F.date_format("iso", "yyyy-MM-dd HH:mm:ss.SSS").alias("iso"), F.date_format("day", "MM-dd").alias("day"),
                     F.date_format("month", "MM-dd").alias("month")).collect()
    assert [r.iso for r in got] == ["2024-01-02 10:00:00.123", "2024-01-02 10:00:00.000"]
    assert [r.day for r in got] == ["03-02", "03-13"] and [r.month for r in got] == ["02-03", "03-04"]


def test_undetermined_and_infinite_tests(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    for equal_var in (True, False):
        r = ht.t_test(df, "g", "x", equal_var=equal_var).first()
        assert r.t_stat == -math.inf and r.p_value == 0.0 and r.verdict == "significant"
    r = ht.t_test(df.withColumn("x", F.lit(1.0)), "g", "x").first()
    assert r.t_stat is None and r.verdict == "undetermined"
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert ht.shapiro(two, "x").first().verdict == "undetermined"


def test_workbook_headers(spark, tmp_path):
    from tablelens.sources.workbook import read_workbooks
    _xlsx(str(tmp_path / "a.xlsx"), [["x", None, "x", "a.b"], [1, "p", 2, "q"], [3, "r", 4, "s"]])
    df = read_workbooks(spark, str(tmp_path))
    assert sorted(df.columns) == ["Unnamed: 1", "a.b", "x", "x.1"]
    assert sorted((r["x"], r["x.1"], r["Unnamed: 1"]) for r in df.collect()) == [(1, 2, "p"), (3, 4, "r")]


def test_queries_run_from_another_folder(tmp_path):
    """The package reaches Python workers that were not started beside it."""
    code = ("import sys, importlib.util as u\n"
            "s = u.spec_from_file_location('__spark_entry__', '/root/repo/__spark_entry__.py'); e = u.module_from_spec(s); s.loader.exec_module(e)\n"
            "from pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "print('ROWS', len(e.queries()['t_test_full'](spark, '/root/testdata/sf0.001').collect()))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in got.stdout, got.stderr[-2000:]
