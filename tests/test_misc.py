import datetime as dt
import os
import tempfile

import pytest

from tablelens import fixtures as fx
from tablelens.operators import charts as H
from tablelens.operators import profile as P
from tablelens.sources.delimited import read_csv
from tablelens.sources.export import export_csv


def test_sampling_knobs_are_deterministic_and_bounded(spark, sf001):
    li = fx.table(spark, sf001, "lineitem")
    a = H.strip_points(li, "l_returnflag", "l_extendedprice", max_points=1000)
    b = H.strip_points(li, "l_returnflag", "l_extendedprice", max_points=1000)
    ra, rb = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert ra == rb and 500 < len(ra) < 1500
    full = H.strip_points(li, "l_returnflag", "l_extendedprice").count()
    assert full == li.count()
    s = H.scatter_points(li, ["l_quantity", "l_tax"], max_points=2000).count()
    assert 1000 < s < 3000
    qq = H.qq_points(li, "l_tax", max_points=100).collect()
    n = li.count()
    assert len(qq) <= 101 and any(r["pos"] == n for r in qq) and any(r["pos"] == 1 for r in qq)


def test_describe_digits_and_missing_roles(spark, sf001):
    lm = fx.lineitem_missing(spark, sf001)
    d = {r["variable"]: r for r in P.describe_numeric(lm, ["l_extendedprice"], digits=2).collect()}
    assert d["l_extendedprice"]["mean"] == round(d["l_extendedprice"]["mean"], 2)
    roles = {r["variable"]: r["role"] for r in P.missing_columns(lm).collect()}
    assert roles == {"l_quantity": "quantitative", "l_discount": "quantitative", "l_returnflag": "qualitative"}
    assert [r["variable"] for r in P.missing_columns(lm, "qualitative").collect()] == ["l_returnflag"]


def test_single_file_export(spark):
    tmp = tempfile.mkdtemp(prefix="tl-one-")
    df = spark.range(100).selectExpr("id", "id / 3 AS x").repartition(4)
    p = export_csv(df, tmp, "one_file", single_file=True, today=dt.date(2024, 2, 2))
    parts = [f for f in os.listdir(p) if f.startswith("part-")]
    assert len(parts) == 1
    assert read_csv(spark, p).count() == 100


def test_a_sample_sorts_few_rows(spark):
    from pyspark.sql import functions as F

    from tablelens.operators.columns import sample_rows
    df = spark.range(0, 20_000, 1, 16).select("id", (F.col("id") % 7).alias("v"))
    got = sample_rows(df, 100, row_key=["id"])
    every = df.orderBy(F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string")).cast("binary")), "id").limit(100)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in every.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = df.where(F.substring(F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string")).cast("binary")), 1, 8)
                     <= F.lit(f"{int((100 + 60 + 16) / 20_000 * 0xFFFFFFFF):08x}")).count()
    assert "md5" in plan.split("Filter")[1] and 100 <= below <= 260
    assert sample_rows(df, 100).count() == 100 and sample_rows(df, 50_000).count() == 20_000 and sample_rows(df, 0).count() == 0
    assert sample_rows(df.limit(0), 5, row_key=["id"]).count() == 0
    assert len({r.id for r in sample_rows(df, 300).collect()}) == 300


def test_a_deep_page_reads_one_row_group(spark):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from tablelens.operators.columns import PositionIndex
    df = spark.range(0, 9000, 1, 6).select((F.col("id") * 7919 % 9001).alias("a.key"), F.col("id").alias("v"))
    index = PositionIndex(df, "a.key", rows_per_group=100)
    order = [(r[0], r[1]) for r in df.orderBy("`a.key`", "v").collect()]
    assert [tuple(r) for r in index.page(711, 10).collect()] == order[7110:7120]
    assert index.page(900, 10).count() == 0 and index.page(0, 3).columns == ["a.key", "v"]
    assert sorted(tuple(r) for r in index.select([5, 8999, 10**9, 5]).collect()) == sorted([order[5], order[8999]])
    assert index.select([]).count() == 0 and index.select(range(0, 9000, 2)).count() == 4500
    assert "PushedFilters: [IsNotNull(_pos), GreaterThanOrEqual(_pos,7110), LessThanOrEqual(_pos,7119)]" in index.page(711, 10)._jdf.queryExecution().toString()
    groups = []
    for f in index.rows.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        at = meta.schema.names.index("_pos")
        groups += [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    assert len(groups) >= 90 and sum(s.min <= 7119 and s.max >= 7110 for s in groups) <= 2
