"""D, E, F, G keys: imputation, conversion, normalisation, dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import convert as conv
from ..operators import dedupe as dd
from ..operators import impute as imp
from ..operators import scale as sc
from ..registry import register
from .sqlgen import D, union_all

LM = fx.LINEITEM_MISSING_SQL
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEYS_SQL = ", ".join(KEYS)
MODE_SQL = ("(SELECT v FROM (SELECT l_returnflag AS v, count(*) AS c FROM {src} AS s "
            "WHERE l_returnflag IS NOT NULL GROUP BY 1) AS t ORDER BY c DESC, v LIMIT 1)")


def _lm(spark, sf):
    return fx.lineitem_missing(spark, sf)


# ------------------------------------------------------------------ D
@register("impute_mean",
          f"SELECT {KEYS_SQL}, coalesce(l_quantity, (SELECT avg(l_quantity) FROM {LM} AS a)) AS l_quantity, "
          f"coalesce(l_discount, (SELECT avg(l_discount) FROM {LM} AS b)) AS l_discount FROM {LM} AS m",
          ["l_quantity", "l_discount"])
def q_impute_mean(spark, sf):
    return imp.impute(_lm(spark, sf), mean=["l_quantity", "l_discount"]).select(
        *KEYS, "l_quantity", "l_discount")


@register("impute_median",
          f"SELECT {KEYS_SQL}, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {LM} AS a)) "
          f"AS l_quantity, coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {LM} AS b)) "
          f"AS l_discount FROM {LM} AS m", ["l_quantity", "l_discount"])
def q_impute_median(spark, sf):
    return imp.impute(_lm(spark, sf), median=["l_quantity", "l_discount"]).select(
        *KEYS, "l_quantity", "l_discount")


@register("impute_zero",
          f"SELECT {KEYS_SQL}, coalesce(l_quantity, CAST(0 AS DOUBLE)) AS l_quantity FROM {LM} AS m",
          ["l_quantity"])
def q_impute_zero(spark, sf):
    return imp.impute(_lm(spark, sf), zero=["l_quantity"]).select(*KEYS, "l_quantity")


@register("impute_mode",
          f"SELECT {KEYS_SQL}, coalesce(l_returnflag, {MODE_SQL.format(src=LM)}) AS l_returnflag "
          f"FROM {LM} AS m")
def q_impute_mode(spark, sf):
    return imp.impute(_lm(spark, sf), mode=["l_returnflag"]).select(*KEYS, "l_returnflag")


def _plan(spark, sf):
    df = _lm(spark, sf)
    model = imp.fit_imputer(df, mean=["l_quantity"], zero=["l_discount"], mode=["l_returnflag"])
    return df, model


def _preview_sql() -> str:
    parts = [
        f"SELECT 'l_quantity' AS variable, 'mean' AS method, {KEYS_SQL}, 'NA' AS before, "
        f"(SELECT avg(l_quantity) FROM {LM} AS a) AS after_value, CAST(NULL AS VARCHAR) AS after_label, "
        f"row_number() OVER (ORDER BY {KEYS_SQL}) AS rn FROM {LM} AS m WHERE l_quantity IS NULL",
        f"SELECT 'l_discount', 'zero', {KEYS_SQL}, 'NA', CAST(0 AS DOUBLE), CAST(NULL AS VARCHAR), "
        f"row_number() OVER (ORDER BY {KEYS_SQL}) FROM {LM} AS m WHERE l_discount IS NULL",
        f"SELECT 'l_returnflag', 'mode', {KEYS_SQL}, 'NA', CAST(NULL AS DOUBLE), {MODE_SQL.format(src=LM)}, "
        f"row_number() OVER (ORDER BY {KEYS_SQL}) FROM {LM} AS m WHERE l_returnflag IS NULL"]
    return (f"SELECT variable, method, {KEYS_SQL}, before, after_value, after_label "
            f"FROM ({union_all(parts)}) AS u WHERE rn <= 3")


@register("impute_preview", _preview_sql(), ["after_value"])
def q_impute_preview(spark, sf):
    df, model = _plan(spark, sf)
    return imp.impute_preview(df, model, KEYS, 3)


def _report_sql() -> str:
    parts = [
        f"SELECT 'l_quantity' AS variable, 'mean' AS method, count(*) FILTER (WHERE l_quantity IS NULL) AS "
        f"missing_before, CAST(0 AS BIGINT) AS missing_after, avg(l_quantity) AS fill_value, "
        f"CAST(NULL AS VARCHAR) AS fill_label FROM {LM} AS m",
        f"SELECT 'l_discount', 'zero', count(*) FILTER (WHERE l_discount IS NULL), CAST(0 AS BIGINT), "
        f"CAST(0 AS DOUBLE), CAST(NULL AS VARCHAR) FROM {LM} AS m",
        f"SELECT 'l_returnflag', 'mode', count(*) FILTER (WHERE l_returnflag IS NULL), CAST(0 AS BIGINT), "
        f"CAST(NULL AS DOUBLE), {MODE_SQL.format(src=LM)} FROM {LM} AS m"]
    return (f"SELECT *, CASE WHEN missing_before > 0 THEN CAST(100 AS DOUBLE) - "
            f"{D('missing_after')} / {D('missing_before')} * 100 END AS success_pct FROM ({union_all(parts)}) AS r")


@register("impute_report", _report_sql(), ["fill_value", "success_pct"])
def q_impute_report(spark, sf):
    df, model = _plan(spark, sf)
    return imp.impute_report(df, model)


# ------------------------------------------------------------------ E
PT = fx.PART_TEXT_SQL


@register("convert_int",
          f"SELECT p_partkey, p_size, coalesce(TRY_CAST(p_size_text AS BIGINT), 0) AS p_size_text FROM {PT} AS p")
def q_convert_int(spark, sf):
    out, _ = conv.convert(fx.part_text(spark, sf), {"p_size": "int64", "p_size_text": "int64"})
    return out.select("p_partkey", "p_size", "p_size_text")


@register("convert_float",
          f"SELECT p_partkey, TRY_CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM {PT} AS p",
          ["p_retailprice"])
def q_convert_float(spark, sf):
    out, _ = conv.convert(fx.part_text(spark, sf), {"p_retailprice": "float64"})
    return out.select("p_partkey", "p_retailprice")


@register("convert_category",
          f"SELECT {KEYS_SQL}, CAST(l_linenumber AS VARCHAR) AS l_linenumber_cat FROM lineitem")
def q_convert_category(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(*KEYS, F.col("l_linenumber").alias("l_linenumber_cat"))
    out, _ = conv.convert(li, {"l_linenumber_cat": "category"})
    return out


@register("convert_text", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def q_convert_text(spark, sf):
    out, _ = conv.convert(fx.table(spark, sf, "customer"), {"c_nationkey": "text"})
    return out.select("c_custkey", "c_nationkey")


@register("convert_datetime",
          f"SELECT o_orderkey, CAST(try_strptime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS o_orderdate "
          f"FROM {fx.ORDER_DATES_TEXT_SQL} AS o")
def q_convert_datetime(spark, sf):
    out, _ = conv.convert(fx.order_dates_text(spark, sf), {"o_orderdate": "datetime"})
    return out.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


def _convert_report_sql() -> str:
    fail_size = "count(*) FILTER (WHERE p_size IS NOT NULL AND TRY_CAST(p_size AS BIGINT) IS NULL)"
    fail_price = ("count(*) FILTER (WHERE p_retailprice IS NOT NULL AND "
                  "TRY_CAST(p_retailprice AS DOUBLE) IS NULL)")
    parts = [
        f"SELECT 'p_size' AS variable, 'string' AS from_type, 'int64' AS to_type, "
        f"CASE WHEN {fail_size} > 0 THEN 'failed' ELSE 'converted' END AS status, {fail_size} AS failed_rows, "
        f"CASE WHEN {fail_size} > 0 THEN CAST(0 AS BIGINT) ELSE count(*) FILTER (WHERE p_size IS NULL) END "
        f"AS nulls_filled FROM {PT} AS p",
        f"SELECT 'p_size_text', 'string', 'int64', 'converted', CAST(0 AS BIGINT), "
        f"count(*) FILTER (WHERE p_size_text IS NULL) FROM {PT} AS p",
        f"SELECT 'p_retailprice', 'string', 'float64', CASE WHEN {fail_price} > 0 THEN 'failed' "
        f"ELSE 'converted' END, {fail_price}, CAST(0 AS BIGINT) FROM {PT} AS p",
        "SELECT 'p_brand', 'string', 'category', 'converted', CAST(0 AS BIGINT), CAST(0 AS BIGINT)",
        "SELECT 'p_name', 'string', 'text', 'skipped (type unchanged)', CAST(0 AS BIGINT), CAST(0 AS BIGINT)"]
    return union_all(parts)


@register("convert_report", _convert_report_sql())
def q_convert_report(spark, sf):
    _, report = conv.convert(fx.part_text(spark, sf), {
        "p_size": "int64", "p_size_text": "int64", "p_retailprice": "float64",
        "p_brand": "category", "p_name": "text"})
    return report


# ------------------------------------------------------------------ F
def _norm_sql(src: str, var: str, key_sql: str, expr: str) -> str:
    return f"SELECT {key_sql}, {var}, {expr} AS {var}_norm FROM {src} AS s"


@register("normalize_standard",
          _norm_sql("lineitem", "l_extendedprice", KEYS_SQL,
                    "(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / "
                    "(SELECT CASE WHEN stddev_pop(l_extendedprice) = 0 THEN 1 ELSE stddev_pop(l_extendedprice) "
                    "END FROM lineitem)"), ["l_extendedprice", "l_extendedprice_norm"])
def q_normalize_standard(spark, sf):
    return sc.normalize(fx.table(spark, sf, "lineitem"), "l_extendedprice", "standard").select(
        *KEYS, "l_extendedprice", "l_extendedprice_norm")


@register("normalize_minmax",
          _norm_sql("lineitem", "l_quantity", KEYS_SQL,
                    "(l_quantity - (SELECT min(l_quantity) FROM lineitem)) / "
                    "(SELECT CASE WHEN max(l_quantity) = min(l_quantity) THEN 1 "
                    "ELSE max(l_quantity) - min(l_quantity) END FROM lineitem)"),
          ["l_quantity", "l_quantity_norm"])
def q_normalize_minmax(spark, sf):
    return sc.normalize(fx.table(spark, sf, "lineitem"), "l_quantity", "minmax").select(
        *KEYS, "l_quantity", "l_quantity_norm")


@register("normalize_robust",
          _norm_sql("lineitem", "l_extendedprice", KEYS_SQL,
                    "(l_extendedprice - (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem)) / "
                    "(SELECT CASE WHEN quantile_cont(l_extendedprice, 0.75) = quantile_cont(l_extendedprice, 0.25) "
                    "THEN 1 ELSE quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) END "
                    "FROM lineitem)"), ["l_extendedprice", "l_extendedprice_norm"])
def q_normalize_robust(spark, sf):
    return sc.normalize(fx.table(spark, sf, "lineitem"), "l_extendedprice", "robust").select(
        *KEYS, "l_extendedprice", "l_extendedprice_norm")


@register("normalize_log",
          _norm_sql("customer", "c_acctbal", "c_custkey",
                    "CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END"), ["c_acctbal", "c_acctbal_norm"])
def q_normalize_log(spark, sf):
    return sc.normalize(fx.table(spark, sf, "customer"), "c_acctbal", "log").select(
        "c_custkey", "c_acctbal", "c_acctbal_norm")


def _norm_report_sql() -> str:
    z = ("((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / "
         "(SELECT stddev_pop(l_extendedprice) FROM lineitem))")
    base = f"(SELECT l_extendedprice AS o, {z} AS z FROM lineitem) AS t"
    return union_all([
        f"SELECT 'min' AS statistic, min(o) AS original, min(z) AS normalized FROM {base}",
        f"SELECT 'max', max(o), max(z) FROM {base}",
        f"SELECT 'mean', avg(o), avg(z) FROM {base}",
        f"SELECT 'std', stddev_samp(o), stddev_samp(z) FROM {base}"])


@register("normalize_report", _norm_report_sql(), ["original", "normalized"])
def q_normalize_report(spark, sf):
    return sc.normalize_report(fx.table(spark, sf, "lineitem"), "l_extendedprice", "standard")


def hist_sql(src: str, var: str, bins: int, density: bool = False, series: str | None = None) -> str:
    """DuckDB twin of charts.histogram (same arithmetic order)."""
    dens = (f", CAST(coalesce(c.count, 0) AS DOUBLE) / (CAST(s.n AS DOUBLE) * CASE WHEN s.w > 0 THEN s.w "
            f"ELSE 1.0 END) AS density") if density else ""
    ser = f", '{series}' AS series" if series else ""
    return (
        f"WITH x AS (SELECT CASE WHEN NOT isnan(CAST({var} AS DOUBLE)) THEN CAST({var} AS DOUBLE) END AS v "
        f"FROM {src}), "
        f"s AS (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n, (max(v) - min(v)) / {bins} AS w FROM x), "
        f"b AS (SELECT CASE WHEN s.w > 0 THEN CAST(least(floor((v - s.lo) / s.w), {bins - 1}) AS INTEGER) "
        f"ELSE 0 END AS bin FROM x, s WHERE v IS NOT NULL), "
        f"c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin) "
        f"SELECT CAST(g.range AS INTEGER) AS bin, s.lo + CAST(g.range AS INTEGER) * s.w AS lower, "
        f"CASE WHEN g.range = {bins - 1} THEN s.hi ELSE s.lo + (CAST(g.range AS INTEGER) + 1) * s.w END AS upper, "
        f"CAST(coalesce(c.count, 0) AS BIGINT) AS count{dens}{ser} "
        f"FROM range({bins}) AS g CROSS JOIN s LEFT JOIN c ON c.bin = g.range")


def _norm_hist_sql() -> str:
    z = ("((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / "
         "(SELECT stddev_pop(l_extendedprice) FROM lineitem))")
    src = f"(SELECT l_extendedprice, {z} AS l_extendedprice_norm FROM lineitem) AS t"
    return union_all([f"SELECT * FROM ({hist_sql(src, 'l_extendedprice', 30, series='original')}) AS a",
                      f"SELECT * FROM ({hist_sql(src, 'l_extendedprice_norm', 30, series='normalized')}) AS b"])


@register("normalize_preview_hist", _norm_hist_sql(), ["lower", "upper"])
def q_normalize_preview_hist(spark, sf):
    return sc.normalize_preview_hist(fx.table(spark, sf, "lineitem"), "l_extendedprice", "standard", 30)


# ------------------------------------------------------------------ G
@register("dedupe_first",
          "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER "
          "(PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) AS t WHERE rn = 1",
          ["value"])
def q_dedupe_first(spark, sf):
    return dd.dedupe(fx.table(spark, sf, "events"), ["user_id", "event_type"], "first", ["event_id"])


@register("dedupe_last",
          "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER "
          "(PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) AS t WHERE rn = 1",
          ["value"])
def q_dedupe_last(spark, sf):
    return dd.dedupe(fx.table(spark, sf, "events"), ["user_id", "event_type"], "last", ["event_id"])


@register("dedupe_all_columns", "SELECT DISTINCT text, lang, source FROM documents")
def q_dedupe_all_columns(spark, sf):
    return dd.dedupe(fx.table(spark, sf, "documents").select("text", "lang", "source"))


@register("dedupe_drop_all",
          "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE text IN "
          "(SELECT text FROM documents GROUP BY text HAVING count(*) = 1)")
def q_dedupe_drop_all(spark, sf):
    return dd.dedupe(fx.table(spark, sf, "documents"), ["text"], keep=False)


@register("dedupe_report",
          "SELECT CAST(sum(c) AS BIGINT) AS initial, count(*) AS remaining, CAST(sum(c) - count(*) AS BIGINT) "
          "AS removed, CAST(sum(c) - count(*) AS DOUBLE) / CAST(sum(c) AS DOUBLE) * 100 AS pct_removed "
          "FROM (SELECT count(*) AS c FROM documents GROUP BY text) AS g", ["pct_removed"])
def q_dedupe_report(spark, sf):
    return dd.dedupe_report(fx.table(spark, sf, "documents"), ["text"])


# ------------------------------------------------------------------ D4 (KNN)
def _knn_sql(k: int = 5) -> str:
    cm = fx.CUSTOMER_MISSING_SQL
    return (
        f"WITH b AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS nk, "
        f"CAST(c_custkey AS DOUBLE) AS ck FROM {cm} AS c), "
        "r AS (SELECT * FROM b WHERE a IS NULL), d AS (SELECT * FROM b WHERE a IS NOT NULL), "
        "p AS (SELECT r.id AS rid, d.id AS did, d.a AS da, sqrt(CAST(3 AS DOUBLE) / 2 * "
        "((r.nk - d.nk) * (r.nk - d.nk) + (r.ck - d.ck) * (r.ck - d.ck))) AS dist FROM r, d), "
        "t AS (SELECT rid, da, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS rn FROM p), "
        f"f AS (SELECT rid, avg(da) AS fill FROM t WHERE rn <= {k} GROUP BY rid) "
        f"SELECT c.c_custkey, coalesce(CAST(c.c_acctbal AS DOUBLE), f.fill) AS c_acctbal "
        f"FROM {cm} AS c LEFT JOIN f ON f.rid = c.c_custkey")


@register("impute_knn", _knn_sql(5), ["c_acctbal"])
def q_impute_knn(spark, sf):
    df = fx.customer_missing(spark, sf)
    out = imp.impute(df, knn=["c_acctbal"], k=5, knn_features=["c_acctbal", "c_nationkey", "c_custkey"],
                     knn_order=["c_custkey"])
    return out.select("c_custkey", "c_acctbal")


@register("impute_preview_knn",
          f"SELECT 'c_acctbal' AS variable, 'knn' AS method, k.c_custkey, 'NA' AS before, k.c_acctbal AS after_value, CAST(NULL AS VARCHAR) AS after_label "
          f"FROM ({_knn_sql(5)}) AS k JOIN {fx.CUSTOMER_MISSING_SQL} AS m ON m.c_custkey = k.c_custkey WHERE m.c_acctbal IS NULL ORDER BY 3 LIMIT 3",
          ["after_value"])
def q_impute_preview_knn(spark, sf):
    df = fx.customer_missing(spark, sf)
    model = imp.fit_imputer(df, knn=["c_acctbal"], k=5, knn_features=["c_acctbal", "c_nationkey", "c_custkey"], knn_order=["c_custkey"])
    return imp.impute_preview(df, model, ["c_custkey"], 3)


_GAPPY = {"o.total": ("o_totalprice / 1000", 5), "cust id": ("o_custkey", 7), "day": ("date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)", 11),
          "`mod`": ("o_orderkey % 97", 13), "x.y": ("(o_orderkey * 7919) % 1009 / 10.0", 3)}
_GAPPY_COLUMNS = ", ".join(f"CASE WHEN (o_orderkey + {m}) % {m} <> 0 THEN CAST({e} AS DOUBLE) END AS f{i}" for i, (e, m) in enumerate(_GAPPY.values()))
_GAPPY_SHARED = " + ".join(f"CASE WHEN r.f{i} IS NOT NULL AND d.f{i} IS NOT NULL THEN 1 ELSE 0 END" for i in range(1, 5))
_GAPPY_SQUARES = " + ".join(f"coalesce((r.f{i} - d.f{i}) * (r.f{i} - d.f{i}), 0)" for i in range(1, 5))


@register("impute_knn_gappy",
          f"WITH b AS (SELECT o_orderkey AS id, {_GAPPY_COLUMNS} FROM orders), "
          f"p AS (SELECT r.id, d.id AS did, d.f0 AS v, {_GAPPY_SHARED} AS n, {_GAPPY_SQUARES} AS sq "
          "FROM (SELECT * FROM b WHERE f0 IS NULL) AS r, (SELECT * FROM b WHERE f0 IS NOT NULL) AS d), "
          "t AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY sqrt(CAST(5 AS DOUBLE) / n * sq), did) AS rn FROM p WHERE n > 0), "
          "f AS (SELECT id, avg(v) AS fill FROM t WHERE rn <= 7 GROUP BY id) "
          "SELECT b.id AS o_orderkey, coalesce(f0, fill, (SELECT avg(f0) FROM b)) AS total FROM b LEFT JOIN f USING (id)", ["total"])
def q_impute_knn_gappy(spark, sf):
    """Five features, each with gaps, and names with dots, spaces and back quotes."""
    exprs = [F.col("o_totalprice") / 1000, F.col("o_custkey"), F.date_diff("o_orderdate", F.lit("1990-01-01").cast("date")),
             F.col("o_orderkey") % 97, (F.col("o_orderkey") * 7919) % 1009 / 10.0]
    df = fx.table(spark, sf, "orders").select("o_orderkey", *(
        F.when((F.col("o_orderkey") + m) % m != 0, e.cast("double")).alias(n) for (n, (_, m)), e in zip(_GAPPY.items(), exprs)))
    out = imp.impute(df, knn=["o.total"], k=7, knn_features=list(_GAPPY), knn_order=["o_orderkey"])
    return out.select("o_orderkey", F.col("`o.total`").alias("total"))


@register("impute_report_total",
          f"WITH r AS ({_report_sql()}) SELECT * FROM r UNION ALL "
          "SELECT 'TOTAL', CAST(NULL AS VARCHAR), CAST(sum(missing_before) AS BIGINT), "
          "CAST(sum(missing_after) AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), "
          "CASE WHEN sum(missing_before) > 0 THEN CAST(100 AS DOUBLE) - CAST(sum(missing_after) AS DOUBLE) / "
          "CAST(sum(missing_before) AS DOUBLE) * 100 END FROM r", ["fill_value", "success_pct"])
def q_impute_report_total(spark, sf):
    df, model = _plan(spark, sf)
    return imp.impute_report(df, model, with_total=True)
